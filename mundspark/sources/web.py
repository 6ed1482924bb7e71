"""Podcast feeds and saved web pages: links, titles and audio addresses by the first source that has them. Nothing is
fetched."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mundspark.functions.columns import safe_name, slug_title, strip


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(title, description, published, url) of the items of RSS files; url is that of the enclosure, else the link."""
    d = spark.read.format("xml").option("rowTag", "item").schema("title string, description string, pubDate string, link string, enclosure struct<_url: string>").load(path)
    return d.select(strip(F.col("title")).alias("title"), "description", F.col("pubDate").alias("published"), F.coalesce("enclosure._url", "link").alias("url"))


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.links, self.meta, self.heading, self.title, self.audio, self.downloads = url, [], {}, "", "", [], []
        self._in: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.links.append(urljoin(self.url, a["href"]))
            if "download" in a or a["href"].split("?")[0].endswith((".mp3", ".m4a")):
                self.downloads.append(self.links[-1])
        elif tag == "meta" and a.get("content"):
            self.meta.setdefault(a.get("property") or a.get("name") or "", a["content"])
        elif tag in ("audio", "source") and a.get("src"):
            self.audio.append(urljoin(self.url, a["src"]))
        if tag in ("h1", "title"):
            self._in.append(tag)

    def handle_endtag(self, tag):
        if self._in and self._in[-1] == tag:
            self._in.pop()

    def handle_data(self, data):
        if self._in and self._in[-1] == "h1" and not self.heading.strip():
            self.heading += data
        elif self._in and self._in[-1] == "title":
            self.title += data


def parse_pages(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, og_title, heading, title, og_audio, downloads, audio, links) of saved pages; NULL pages have no links. Broken
    mark-up is read as far as it goes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for u, h in zip(f["url"], f["html"]):
                p = _Page(u or "")
                p.feed(h or "")
                rows.append((u, p.meta.get("og:title"), p.heading.strip() or None, p.title.strip() or None, p.meta.get("og:audio"), p.downloads, p.audio, list(dict.fromkeys(p.links))))
            if rows:
                yield pd.DataFrame(rows, columns=["url", "og_title", "heading", "title", "og_audio", "downloads", "audio", "links"])

    return df.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, "url string, og_title string, heading string, title string, og_audio string, downloads array<string>, audio array<string>, links array<string>")


def series_links(pages: DataFrame, part: str) -> DataFrame:
    """(link) of all pages' different links whose path contains part."""
    return pages.select(F.explode("links").alias("link")).where(F.col("link").contains(part)).distinct()


def series_info(pages: DataFrame) -> DataFrame:
    """(url, name): the title in the page's metadata, else its heading, else the last part of its address."""
    slug = slug_title(F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/"), -1))
    return pages.select("url", F.coalesce(F.nullif(strip(F.col("og_title")), F.lit("")), "heading", slug).alias("name"))


def episode_audio(pages: DataFrame, podcast: str) -> DataFrame:
    """(filename, title, podcast_name, url, audio_url): audio from the metadata, else a download link, else an audio
    element; pages without any are left out."""
    audio = F.coalesce("og_audio", F.try_element_at("downloads", F.lit(1)), F.try_element_at("audio", F.lit(1)))
    title = F.coalesce("og_title", "heading", "title")
    return pages.select(F.concat(safe_name(title), F.lit(".mp3")).alias("filename"), title.alias("title"), F.lit(podcast).alias("podcast_name"), "url", audio.alias("audio_url")).where("audio_url is not null")
