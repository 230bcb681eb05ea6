"""Readers for what the feeds deliver: JSON listings, Atom and RSS, HTML pages, Markdown reports, state files.

Every reader takes a path (file, folder or pattern) and gives a DataFrame; fetching is not their business. Schemas are
given, never inferred; a corrupt file gives no rows rather than an error where the format allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import schema
from eventloom.functions.dates import flexible_date
from eventloom.functions.web import article_body, clean_xml, page_title, strip_publisher, strip_tags, url_key
from eventloom.operators.metrics import carry_section, inverted_to_text


def _evidence(url: Column, kind: str, name: str, score: float | None = None) -> Column:
    return F.array(
        F.struct(
            url.alias("url"), F.lit(kind).alias("source_type"), F.lit(name).alias("name"), F.lit(score).cast("double").alias("credibility_score"), F.lit(None).cast("string").alias("published_at")
        )
    )


def _json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("_file", F.col("_metadata.file_path"))


def github_repositories(spark: SparkSession, path: str, per_query: int = 15, as_of: Column | None = None, pushed_within_hours: int | None = None) -> DataFrame:
    """Repositories of search responses (one file for each query), the first ``per_query`` of each, one for each URL in the
    order of the files' names. With ``pushed_within_hours`` those that were not pushed to so shortly before ``as_of`` are left
    out first (the track of established repositories; that of rising ones has no such bound)."""
    item = "struct<full_name:string,name:string,html_url:string,description:string,stargazers_count:bigint,forks_count:bigint,open_issues_count:bigint,language:string,topics:array<string>,created_at:string,pushed_at:string,owner:struct<login:string>>"
    rows = _json(spark, path, f"items array<{item}>").select("_file", F.posexplode("items").alias("pos", "i")).where(F.col("pos") < per_query)
    if pushed_within_hours is not None:
        age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("i.pushed_at").try_cast("timestamp"))
        rows = rows.where(age <= pushed_within_hours * 3600)
    rows = rows.withColumn("_key", url_key("i.html_url")).where("_key <> ''")
    first = rows.groupBy("_key").agg(F.min_by("i", F.struct("_file", "pos")).alias("i"), F.min(F.struct("_file", "pos")).alias("seq"))
    return first.select(
        F.col("i.name").alias("project_name"), F.col("i.html_url").alias("repo_url"), F.col("i.owner.login").alias("owner"), F.col("i.stargazers_count").alias("stars"),
        F.col("i.forks_count").alias("forks"), F.col("i.open_issues_count").alias("open_issues"), F.col("i.language").alias("primary_language"),
        F.substring("i.created_at", 1, 10).alias("created_at"), F.substring("i.pushed_at", 1, 10).alias("updated_at"), F.coalesce("i.topics", F.array().cast("array<string>")).alias("tech_tags"),
        F.coalesce("i.description", F.lit("")).alias("description"), _evidence(F.col("i.html_url"), "github_repo", "repository", 5.0).alias("source_urls"), "seq",
    )


def studio_listing(spark: SparkSession, path: str, per_query: int = 10) -> DataFrame:
    """Entries of a nested listing ``Data.Studios``."""
    item = "struct<Name:string,Path:string,Description:string,Stars:bigint,GmtModified:string>"
    rows = _json(spark, path, f"Data struct<Studios:array<{item}>>").select("_file", F.posexplode("Data.Studios").alias("pos", "i")).where(F.col("pos") < per_query)
    return rows.select(F.col("i.Name").alias("project_name"), F.col("i.Path").alias("owner"), F.col("i.Stars").alias("stars"), F.coalesce("i.Description", F.lit("")).alias("description"), F.substring("i.GmtModified", 1, 10).alias("updated_at"), _evidence(F.col("i.Path"), "modelscope", "studio listing").alias("source_urls"))


def _delivered(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` records of each file, in the order in which they stand in it. Files are read whole, so the order of
    a file's rows is that of its array; numbers given along the scan keep it."""
    from pyspark.sql import Window

    numbered = df.withColumn("_i", F.monotonically_increasing_id())
    return numbered.withColumn("pos", F.row_number().over(Window.partitionBy("_file").orderBy("_i")) - 1).where(F.col("pos") < most).drop("_i")


def model_listing(spark: SparkSession, path: str, per_query: int = 6, tags: int = 8) -> DataFrame:
    """Models of a listing whose ids are ``owner/name``, the first ``per_query`` delivered of each file; tags of pipelines left out."""
    rows = _delivered(_json(spark, path, "id string, likes bigint, downloads bigint, tags array<string>, lastModified string, createdAt string"), per_query)
    parts = F.split("id", "/")
    kept = F.slice(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: ~t.startswith("pipeline")), 1, tags)
    url = F.concat(F.lit("https://huggingface.co/"), F.col("id"))
    return rows.select(F.element_at(parts, -1).alias("project_name"), url.alias("repo_url"), F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("")).alias("owner"), F.col("likes").alias("stars"), kept.alias("tech_tags"), F.substring("lastModified", 1, 10).alias("updated_at"), F.substring("createdAt", 1, 10).alias("created_at"), _evidence(url, "huggingface", "model listing").alias("source_urls"))


def gitee_repositories(spark: SparkSession, path: str, per_query: int = 6) -> DataFrame:
    """Repositories of search responses, the first ``per_query`` delivered of each file."""
    rows = _delivered(_json(spark, path, "full_name string, name string, html_url string, description string, stargazers_count bigint, forks_count bigint, language string, created_at string, pushed_at string"), per_query)
    return rows.select(F.col("name").alias("project_name"), F.col("html_url").alias("repo_url"), F.split("full_name", "/")[0].alias("owner"), F.col("stargazers_count").alias("stars"), F.col("forks_count").alias("forks"), F.coalesce("description", F.lit("")).alias("description"), F.substring("pushed_at", 1, 10).alias("updated_at"), _evidence(F.col("html_url"), "gitee", "repository").alias("source_urls"))


def arxiv_entries(spark: SparkSession, path: str, per_query: int = 10) -> DataFrame:
    """Entries of Atom responses, the first ``per_query`` of each file: (paper_id, title, abstract, published_at, authors, category)."""
    ddl = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>"
    rows = _delivered(spark.read.format("xml").option("rowTag", "entry").schema(ddl).load(path).withColumn("_file", F.col("_metadata.file_path")), per_query)
    return rows.select(
        F.regexp_replace(F.regexp_extract("id", r"abs/([^/\s]+(?:/[^/\s]+)?)$", 1), r"v\d+$", "").alias("paper_id"), clean_xml("title").alias("title"), clean_xml("summary").alias("abstract"),
        F.substring("published", 1, 10).alias("published_at"), F.transform("author", lambda a: a["name"]).alias("authors"), F.col("category")[0]["_term"].alias("category"),
    )


def openalex_works(spark: SparkSession, path: str) -> DataFrame:
    """Works of a listing, abstracts put together from their inverted index; a hint where they are cited more than 50 times."""
    item = "struct<id:string,display_name:string,publication_date:string,cited_by_count:bigint,abstract_inverted_index:map<string,array<int>>>"
    rows = _json(spark, path, f"results array<{item}>").select(F.explode("results").alias("r"))
    return rows.select(
        F.element_at(F.split("r.id", "/"), -1).alias("paper_id"), F.col("r.display_name").alias("title"), F.col("r.publication_date").alias("published_at"), inverted_to_text(F.col("r.abstract_inverted_index")).alias("abstract"),
        F.when(F.col("r.cited_by_count") > 50, F.concat(F.lit("高引用("), F.col("r.cited_by_count").cast("string"), F.lit(")"))).alias("influence_hint"),
    )


def daily_papers(spark: SparkSession, path: str, most: int = 15) -> DataFrame:
    """Papers of daily lists, the first ``most`` delivered of each file, with a hint where they have more than 20 votes."""
    rows = _json(spark, path, "paper struct<id:string,title:string,summary:string,upvotes:bigint>, publishedAt string")
    rows = _delivered(rows, most)
    return rows.select(F.col("paper.id").alias("paper_id"), F.col("paper.title").alias("title"), F.col("paper.summary").alias("abstract"), F.substring("publishedAt", 1, 10).alias("published_at"),
                       F.when(F.col("paper.upvotes") > 20, F.concat(F.lit("HF 热议("), F.col("paper.upvotes").cast("string"), F.lit(")"))).alias("influence_hint"))


def search_hits(spark: SparkSession, path: str, as_of: Column, max_days: int, most: int = 10) -> DataFrame:
    """Hits of a news search: (file, pos, title, link, published_at, snippet), no older than ``max_days``, the first ``most`` of each file."""
    hit = "struct<title:string,url:string,created_at:string,points:bigint,story_text:string>"
    rows = _json(spark, path, f"hits array<{hit}>").select("_file", F.posexplode("hits").alias("pos", "h")).where(F.col("pos") < most)
    age = F.datediff(as_of.cast("date"), F.substring("h.created_at", 1, 10).try_cast("date"))
    rows = rows.where((F.coalesce("h.title", F.lit("")) != "") & age.between(0, max_days))
    return rows.select(F.col("_file").alias("file"), "pos", F.col("h.title").alias("title"), F.coalesce("h.url", F.lit("")).alias("link"), F.substring("h.created_at", 1, 10).alias("published_at"), strip_tags("h.story_text").alias("snippet"))


def news_query(spark: SparkSession, path: str, most: int = 6) -> DataFrame:
    """Items of an aggregator's feed: undated ones dropped, the publisher taken off the headline, the first ``most`` of each feed."""
    rows = feed_items(spark, path, None).where("published_at is not null")
    from pyspark.sql import Window

    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("pos"))).where(F.col("_n") <= most).drop("_n")
    return first.withColumn("title", strip_publisher("title"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))


def feed_items(spark: SparkSession, path: str, most: int | None = 20) -> DataFrame:
    """Items of RSS and entries of Atom feeds: (file, pos, title, link, published_at, snippet), the first ``most`` of a feed (None: all).

    By patterns rather than an XML parser, since feeds are often not well-formed.
    """
    items = F.regexp_extract_all("doc", F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1)
    rows = _documents(spark, path).select("file", F.posexplode(items if most is None else F.slice(items, 1, most)).alias("pos", "item"))
    tag = lambda name: F.regexp_extract("item", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
    link = F.coalesce(F.nullif(F.trim(clean_xml(tag("link"))), F.lit("")), F.regexp_extract("item", r'(?is)<link\b[^>]*href="([^"]+)"', 1))
    when = F.coalesce(*[F.nullif(clean_xml(tag(n)), F.lit("")) for n in ("pubDate", "published", "updated")])
    body = F.coalesce(*[F.nullif(tag(n), F.lit("")) for n in ("description", "summary", "content")], F.lit(""))
    return rows.select("file", "pos", strip_tags(clean_xml(tag("title"))).alias("title"), link.alias("link"), flexible_date(when).alias("published_at"), F.substring(strip_tags(clean_xml(body)), 1, 300).alias("snippet"))


def html_cards(spark: SparkSession, path: str, href_prefix: str) -> DataFrame:
    """Anchors of listing pages whose address begins with a prefix, the first of each address: (file, href, text)."""
    found = F.regexp_extract_all("doc", F.lit(rf'(?is)(<a\b[^>]*href="{href_prefix}[^"]*"[^>]*>.*?</a>)'), 1)
    rows = _documents(spark, path).select("file", F.posexplode(found).alias("pos", "a"))
    rows = rows.select("file", "pos", F.regexp_extract("a", r'(?i)href="([^"]+)"', 1).alias("href"), strip_tags("a").alias("text"))
    return rows.groupBy("file", "href").agg(F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, body) of article pages."""
    return _documents(spark, path).select("file", page_title("doc").alias("title"), article_body("doc").alias("body"))


def with_details(cards: DataFrame, details: DataFrame, base: str) -> DataFrame:
    """Cards of a listing with title and body of the pages that they lead to; ``details`` is (url, title, body), and addresses of
    cards are taken from ``base`` on. A card whose page is missing keeps its own text and has no body."""
    url = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/")), F.col("href")))
    pages = details.groupBy("url").agg(F.first("title").alias("_title"), F.first("body").alias("body"))
    joined = cards.withColumn("url", url).join(pages, "url", "left")
    return joined.withColumn("title", F.coalesce(F.nullif(F.col("_title"), F.lit("")), F.col("text"))).drop("_title")


def report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, section, title) of numbered entries of Markdown reports; ``section`` is the heading they stand under."""
    lines = _documents(spark, path).select("file", F.posexplode(F.split("doc", r"\r?\n")).alias("line_no", "line"))
    heading = F.nullif(F.regexp_extract("line", r"^##\s+(.+?)\s*$", 1), F.lit(""))
    marked = carry_section(lines, "file", "line_no", heading)
    entry = r"^###\s+\d+\.\s*(.+?)\s*$"
    return marked.where(F.col("line").rlike(entry)).select("file", "line_no", "section", F.regexp_extract("line", entry, 1).alias("title"))


def html_modules(spark: SparkSession, path: str, module_class: str = "module") -> DataFrame:
    """(file, pos, module, block) of archive pages split at the headings of their modules."""
    blocks = F.split("doc", rf'(?i)(?=<section[^>]*class="[^"]*{module_class}[^"]*")')
    rows = _documents(spark, path).select("file", F.posexplode(F.slice(blocks, 2, F.size(blocks))).alias("pos", "block"))
    return rows.select("file", "pos", strip_tags(F.regexp_extract("block", r"(?is)<h2[^>]*>(.*?)</h2>", 1)).alias("module"), "block")


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """(date, file) of archived reports in folders by date, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "report_*.md").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})/", 1).alias("date"), F.col("path").alias("file")).where("date <> ''").orderBy(F.desc("date"), "file")


def reported_titles(spark: SparkSession, path: str) -> DataFrame:
    """(report_date, category, key) of the state file of reported titles."""
    raw = _documents(spark, path).select(F.explode(F.from_json("doc", "map<string,map<string,array<string>>>")).alias("report_date", "by"))
    return raw.select("report_date", F.explode("by").alias("category", "keys")).select("report_date", "category", F.explode("keys").alias("key"))


def feedback_file(spark: SparkSession, path: str) -> DataFrame:
    """Records of the feedback file; none where it is missing or corrupt."""
    try:
        rows = spark.read.schema(schema.FEEDBACK + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        return rows.where("id is not null").drop("_corrupt_record")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema.FEEDBACK)
        raise


def cache_entries(spark: SparkSession, path: str, as_of: Column, max_hours: int) -> DataFrame:
    """(item, stale) of JSON caches."""
    rows = _json(spark, path, schema.CACHE)
    age = as_of.cast("long") - F.col("meta.written_at").cast("timestamp").cast("long")
    return rows.select(F.explode("items").alias("item"), F.coalesce(age > max_hours * 3600, F.lit(True)).alias("stale"))


def env_settings(text: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """``KEY=value`` lines of a settings file, quotes and comments off; what the environment sets holds."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = line.split("=", 1)
            out[key.strip()] = value.strip().strip("\"'")
    return out | {k: v for k, v in (environment or {}).items() if k in out}
