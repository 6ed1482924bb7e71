"""Queries of problems 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mundspark.llm.turns import repeated_runs, speaker_turns, unnamed_speakers
from mundspark.runtime import table


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Speaker turns of every episode."""
    return speaker_turns(table(spark, sf, "transcript_segments")).select("episode_id", "speaker_no", "first_segment_id", "last_segment_id")


def p6_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Speaker turns with their times and clean text."""
    return speaker_turns(table(spark, sf, "transcript_segments"))


def p6_unnamed(spark: SparkSession, sf: str) -> DataFrame:
    """The model's speaker for each segment that names none."""
    return unnamed_speakers(table(spark, sf, "transcript_segments"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of two or more segments with the same words."""
    return repeated_runs(table(spark, sf, "transcript_segments")).select("episode_id", "first_segment_id", "last_segment_id")


def p7_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The runs as one event each, with count, first start and duration."""
    return repeated_runs(table(spark, sf, "transcript_segments"))


def p6_times(spark: SparkSession, sf: str) -> DataFrame:
    """Segments, start and end of every turn."""
    return speaker_turns(table(spark, sf, "transcript_segments")).drop("text")


def p7_events(spark: SparkSession, sf: str) -> DataFrame:
    """Count, first start and duration of every run."""
    return repeated_runs(table(spark, sf, "transcript_segments")).drop("text")


QUERIES = {"p6_found": p6_found, "p6_turns": p6_turns, "p6_times": p6_times, "p6_unnamed": p6_unnamed, "p7_found": p7_found, "p7_runs": p7_runs, "p7_events": p7_events}

# In these tables every remark in brackets or stars is a time, a label or a sound note; other sounds stand between dashes.
_NAME = "(?:speaker(?:in)?|sprecher(?:in)?|spkr?)"
_HEAD = rf"(?i)^[^\p{{L}}\p{{N}}_]*(?:[\[(<{{]\s*{_NAME}[\s_.\-]*0*([0-9]{{1,6}})\s*[\])>}}]\s*:?|{_NAME}[\s_.\-]*0*([0-9]{{1,6}})\s*(?::|[–—-](?:\s|$))|s[\s_.\-]?0*([0-9]{{1,6}})\s*:)"
_number = lambda t: "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, '{_HEAD}', {i}), '')" for i in (1, 2, 3)) + ")"
_SAID = rf"""d as (select min(segment_id) as id, episode_id, start, "end", speaker, text from transcript_segments where text is not null group by episode_id, podcast, start, "end", speaker, text, overlap_coverage),
m as (select id, episode_id, cast(round(start * 1000) as bigint) as s, case when isnan("end") or round("end" * 1000) <= round(start * 1000) then null else cast(round("end" * 1000) as bigint) end as e,
  nullif(regexp_extract(coalesce(speaker, ''), '(?i)^[^\p{{L}}\p{{N}}_]*(?:{_NAME}|s)?[\s_.\-]*0*([0-9]{{1,6}})[^\p{{L}}\p{{N}}_]*$', 1), '') as named,
  regexp_replace(nfc_normalize(text), '[\[(<{{]\s*[0-9]{{1,3}}(?::[0-9]{{2}}){{1,2}}(?:[.,][0-9]{{1,3}})?\s*[\])>}}]|\b[0-9]{{1,3}}:[0-9]{{2}}:[0-9]{{2}}(?:[.,][0-9]{{1,3}})?', ' ', 'g') as t from d),
n as (select *, coalesce(named, {_number("t")}) as who, regexp_replace(t, '{_HEAD}', ' ') as u from m),
o as (select *, regexp_replace(u, '\[[^\[\]]*\]|\([^()]*\)|\{{[^{{}}]*\}}|<[^<>]*>|\*[^*]+\*|[–—-]\s*[Mm]usik\s*[–—-]', ' ', 'g') as v from n),
q as (select *, coalesce(who, {_number("v")}) as label, list_filter(string_split(trim(regexp_replace(lower(regexp_replace(v, '{_HEAD}', ' ')), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g')), ' '),
  lambda w: w <> '' and not regexp_matches(w, '^(ä+h+m*|ä+m+|ö+h+m*|e+h+m+|u+h+m+|h+m+|m+h+m+)$')) as words from o),
said as (select id, episode_id, s, e, cast(label as integer) as speaker_no, array_to_string(words, ' ') as plain,
  replace(replace(replace(replace(array_to_string(words, ' '), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') as words from q where len(words) > 0)"""
_TURNS = f"""with {_SAID}, a as (select *, speaker_no is distinct from lag(speaker_no) over w as new, row_number() over w as o from said where speaker_no is not null window w as (partition by episode_id order by s nulls last, id)),
b as (select *, count(*) filter (new) over (partition by episode_id order by o) as turn from a)
select episode_id, speaker_no, arg_min(id, o) as first_segment_id, arg_max(id, o) as last_segment_id, count(*)::integer as n, arg_min(s, o) as start_ms, max(coalesce(e, s)) as end_ms from b group by episode_id, turn, speaker_no"""
_RUNS = f"""with {_SAID}, a as (select *, lag(words) over w as pw, lag(plain) over w as pp, row_number() over w as o from said window w as (partition by episode_id order by s nulls last, id)),
b as (select *, coalesce(words = pw or (len(string_split(words, ' ')) = len(string_split(pw, ' ')) and regexp_replace(words, '[^0-9 ]', '', 'g') = regexp_replace(pw, '[^0-9 ]', '', 'g')
  and least(levenshtein(words, pw), levenshtein(plain, pp)) <= 2), false) as same from a),
c as (select *, count(*) filter (not same) over (partition by episode_id order by o) as run from b)
select episode_id, arg_min(id, o) as first_segment_id, arg_max(id, o) as last_segment_id, count(*)::bigint as n, arg_min(s, o) as start_ms, max(coalesce(e, s)) - arg_min(s, o) as duration_ms from c group by episode_id, run having count(*) > 1"""
SQL = {
    "p6_found": f"select episode_id, speaker_no, first_segment_id, last_segment_id from ({_TURNS})",
    "p6_times": _TURNS,
    "p7_found": f"select episode_id, first_segment_id, last_segment_id from ({_RUNS})",
    "p7_events": _RUNS,
}
