"""Readers of feeds and state, and the registry of source plugins."""

from pyspark.sql import SparkSession

from eventloom.sources import payloads
from eventloom.sources.registry import register


def _plugin(reader):
    def read(spark: SparkSession, options: dict):
        return reader(spark, **options)

    return read


for _name, _reader in {
    "github": payloads.github_repositories, "studios": payloads.studio_listing, "models": payloads.model_listing, "gitee": payloads.gitee_repositories, "arxiv": payloads.arxiv_entries,
    "openalex": payloads.openalex_works, "daily_papers": payloads.daily_papers, "feeds": payloads.feed_items, "cards": payloads.html_cards, "articles": payloads.articles, "reports": payloads.report_lines,
}.items():
    register(_name)(_plugin(_reader))
