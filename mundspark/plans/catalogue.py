"""The modules that hold the core's queries."""

from mundspark.plans import audits, chunking, files, problems, speech, tables

MODULES = (problems, tables, chunking, speech, audits, files)
