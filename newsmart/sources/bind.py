"""The news archive seen over the provided tables.

``documents`` are articles, ``labels`` drive annotations, ``pages`` carry URLs and
markup, ``events`` are reader actions and ``orders`` give daily closes. Every
column is a plain expression over its table, so pruning and pushdown still reach
the scan and nothing is shuffled to build an article.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions.text import capital_runs, str_array, strip
from newsmart.session import prepare

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC
MONTH_SECONDS = 2592000

TIERS = ["primary", "institutional", "useful", "open_source_signal", "social_signal", "state_affiliated"]
TYPES = ["rss", "news_feed", "CENTRAL_BANK", "INSTITUTIONAL_RESEARCH", "html", "COMPANY_PRIMARY", "regulator"]
FAMILIES = list(lx.FAMILY_LABELS)
SOURCE_COUNTRIES = ["US", "GB", "CN", "FR", "IN", "JP", "DE", "RU", "SA", "AE", "SE", "SG", "BR", "EE"]
NATION_CODES = list(lx.COUNTRY_NAMES)[:25]
TOPICS = ["#inflation", "ai chips", "Trade Policy", "#Oil", "climate", "elections", "#supply chain", "Rates",
          "semiconductors", "shipping", "Gold", "grain"]
MENTION_TYPES = ["company", "person", "Country", "central bank", "government", "technology", "product",
                 "commodity", "location", "UNKNOWN", "research institute", "startup company"]
COUNTRY_MENTIONS = ["United States", "China", "india", "UK", "Germany", "Japan", "France", "Russia", "Brazil",
                    "Saudi Arabia", "Sweden", "Atlantis"]
RETRY_STATES = ["timeout", "processing", "invalid_json", "success"]
ACTIONS = {"click": "read", "purchase": "save", "view": "unread", "error": "unsave", "signup": "save"}

# A dimension with at most this many rows is small enough to broadcast.
DIMENSION_ROWS = 100_000
_scan_partitions: dict[tuple, int] = {}


def pick(values, index: Column) -> Column:
    """values[index mod length]"""
    return F.element_at(str_array(values), (index % len(values)).cast("int") + 1)


class Tables:
    """Lazily bound frames of one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = prepare(spark)
        self.path = path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def version(self) -> int:
        """A digest of the names, sizes and times of the folder's files: other data, another version."""
        conf, path = self.spark._jsc.hadoopConfiguration(), self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files, found = path.getFileSystem(conf).listFiles(path, True), []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return hash(tuple(sorted(found)))

    def spread(self, name: str) -> DataFrame:
        """The table over at least as many partitions as there are cores.

        For work that is heavy per row. A table of many files already has more and is left alone;
        one small file would otherwise keep a single core busy.
        """
        df, cores = self.raw(name), self.spark.sparkContext.defaultParallelism
        key = (self.spark.sparkContext.applicationId, self.path, name)
        if key not in _scan_partitions:
            _scan_partitions[key] = df.rdd.getNumPartitions()
        return df.repartition(cores) if _scan_partitions[key] < cores else df

    # --- articles -------------------------------------------------------------
    def articles(self, heavy: bool = False) -> DataFrame:
        """Articles; ``heavy`` spreads them for text work that dominates the scan."""
        d = self.spread("documents") if heavy else self.raw("documents")
        i = F.col("doc_id")
        line = F.substring_index("text", "\n", 1)
        base = F.lit(EPOCH) + (i * 7919) % MONTH_SECONDS
        body = strip(F.substring(F.col("text"), F.length(line) + 2, F.length("text")))
        number = F.expr("substring(source, 4)").cast("int")
        return d.select(
            i.alias("id"),
            F.when(i % 41 != 5, number + 1).alias("source_id"),
            strip(line).alias("title"),
            F.when(body != "", body).alias("raw_summary"),
            F.concat(F.lit("https://news.example.org/story/"), i - (i % 50 == 1).cast("bigint")).alias(
                "canonical_url"
            ),
            F.when(i % 37 != 0, F.timestamp_seconds(base)).alias("published_at"),
            F.timestamp_seconds(base + (i % 7) * 3600).alias("collected_at"),
            F.col("lang").alias("language"),
            F.when(i % 4 == 0, pick(lx.CATEGORIES, i * 3)).alias("primary_category"),
            F.col("n_chars"),
            strip(F.substring_index("text", "\n", -1)).alias("last_line"),
        )

    def sources(self) -> DataFrame:
        """One row per feed. Grouped from the archive: map-side, then a handful of rows."""
        n = F.expr("substring(name, 4)").cast("int")
        return (
            self.raw("documents").select(F.col("source").alias("name")).distinct()
            .select(
                (n + 1).alias("id"),
                "name",
                F.when(n % 9 != 4, F.concat(F.lit("https://"), "name", F.lit(".example.org/feed.xml"))).alias("feed_url"),
                F.concat(F.lit("https://"), "name", F.lit(".example.org")).alias("website_url"),
                pick(TYPES, n).alias("source_type"),
                pick(FAMILIES, n).alias("source_family"),
                F.when(n % 13 != 12, pick(lx.CATEGORIES, n)).alias("category"),
                pick(TIERS, n).alias("trust_tier"),
                (n % 7 != 3).alias("active"),
                F.when(n % 15 != 14, pick(SOURCE_COUNTRIES, n)).alias("country_code"),
            )
        )

    def annotations(self) -> DataFrame:
        """Up to two annotations per labelled article, in several states."""
        labels = self.raw("labels")
        art = self.articles(heavy=True).select("id", "collected_at", "last_line", "title", "n_chars")
        runs = F.expr("sequence(0, IF(doc_id % 3 = 0, 1, 0))")
        i, k = F.col("doc_id"), F.col("k")
        status = (
            F.when(k == 1, pick(RETRY_STATES, F.floor(i / 3)))
            .when(F.col("toxic") == 1, F.lit("failed"))
            .when(F.col("quality") == 1, F.lit("success"))
            .otherwise(F.lit("out_of_scope"))
        )
        relevant = F.when(k == 1, F.when(F.col("status") == "success", i % 2 == 0)).otherwise(
            F.when(F.col("status") == "success", F.lit(True)).when(F.col("status") == "out_of_scope", F.lit(False))
        )
        entities = F.transform(
            capital_runs(F.col("last_line")),
            lambda name, j: F.struct(
                name.alias("name"),
                F.element_at(str_array(MENTION_TYPES), ((i + j) % len(MENTION_TYPES)).cast("int") + 1).alias("type"),
                F.when(j % 2 == 1, F.col("title")).alias("context"),
            ),
        )
        countries = F.when(
            i % 3 == 0, F.array(pick(COUNTRY_MENTIONS, i), pick(COUNTRY_MENTIONS, i * 5 + 1))
        ).otherwise(F.array(pick(COUNTRY_MENTIONS, i)))
        return (
            labels.withColumn("k", F.explode(runs))
            .join(art, F.col("doc_id") == F.col("id"))
            .withColumn("status", status)
            .withColumn("is_relevant", relevant)
            .withColumn("done", F.col("is_relevant").isNotNull())
            .select(
                (i * 2 + k).alias("annotation_id"),
                i.alias("article_id"),
                F.lit("local").alias("provider"),
                F.lit("m1").alias("model"),
                F.lit("article_analysis").alias("task"),
                F.concat(F.lit("v"), (k + 1).cast("string")).alias("prompt_version"),
                "status",
                "is_relevant",
                F.when(F.col("is_relevant"), pick(lx.CATEGORIES, i * 7 + k * 3)).alias("primary_category"),
                F.when(F.col("done"), (F.lit(30) + (i * 37 + F.col("n_chars")) % 71).cast("int")).alias("importance_score"),
                F.when(F.col("done"), (F.lit(40) + (i * 53 + F.col("n_chars")) % 61).cast("int")).alias("relevance_score"),
                F.when(F.col("is_relevant") & (i % 5 != 0), F.col("last_line")).alias("summary"),
                F.when(F.col("done"), F.array(pick(TOPICS, i), pick(TOPICS, i * 5 + 3))).alias("topics"),
                F.when(F.col("done"), countries).alias("countries"),
                F.when(F.col("done"), entities).alias("entities"),
                (F.col("collected_at") + F.expr("make_interval(0,0,0,0,0,10 + 60 * k)")).alias("created_at"),
                (F.col("collected_at") + F.expr("make_interval(0,0,0,0,0,12 + 60 * k)")).alias("processed_at"),
            )
        )

    def annotation_json(self) -> DataFrame:
        """Annotations with the structured part as JSON text, as an annotator would store it."""
        a = self.annotations()
        body = F.to_json(
            F.struct("is_relevant", "primary_category", "topics", "countries", "entities", "summary",
                     "importance_score", "relevance_score")
        )
        # one annotator writes bare names instead of objects
        names = F.transform("entities", lambda e: e["name"])
        bare = F.to_json(
            F.struct("is_relevant", "primary_category", "topics", "countries", names.alias("entities"), "summary",
                     "importance_score", "relevance_score")
        )
        broken = F.concat(F.lit('{"is_relevant": tr, "n": '), F.col("article_id").cast("string"))
        return a.select(
            "annotation_id", "article_id", "status", "created_at",
            F.when(F.col("status") == "invalid_json", broken)
            .when(F.col("is_relevant").isNull(), None)
            .when(F.col("article_id") % 6 == 0, bare)
            .otherwise(body).alias("output_json"),
        )

    # --- feeds and actions ----------------------------------------------------
    def stream(self, name: str) -> DataFrame:
        """The same table as a file stream, whether it is one file or a folder of files."""
        reader = self.spark.readStream.schema(self.raw(name).schema)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.parquet")
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
            return reader.parquet(f"{self.path}/{name}.parquet")
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.path)

    def feed_items(self, documents: DataFrame | None = None) -> DataFrame:
        """Landed feed entries: each document posted under a page's URL."""
        pages = self.raw("pages")
        n = pages.count()
        d = (self.raw("documents") if documents is None else documents).select(
            "doc_id", "source", (F.col("doc_id") % n).alias("page_id"), F.substring_index("text", "\n", 1).alias("line")
        )
        i = F.col("doc_id")
        return d.join(pages.select("page_id", "url", "html"), "page_id").select(
            i.alias("item_id"),
            F.col("source").alias("source_name"),
            F.when(i % 23 != 7, strip(F.col("line"))).otherwise(F.lit(" ")).alias("title"),
            F.when(i % 11 == 3, F.concat(F.lit("urn:item:"), i.cast("string"))).otherwise(F.col("url")).alias("link"),
            F.when(i % 11 == 3, F.when(i % 2 == 0, F.col("url"))).otherwise(F.lit("tag:x")).alias("guid"),
            F.when(i % 37 != 0, F.timestamp_seconds(F.lit(EPOCH) + (i * 7919) % MONTH_SECONDS)).alias("published_at"),
            F.timestamp_seconds(F.lit(EPOCH) + (i * 7919) % MONTH_SECONDS + (i % 7) * 3600).alias("collected_at"),
            F.col("html").alias("summary"),
        )

    def actions(self) -> DataFrame:
        """Reader actions on articles, from the event stream."""
        e = self.raw("events")
        kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in ACTIONS.items()])
        return e.select(
            "event_id", "user_id", (F.col("event_id") % 97).alias("article_id"), kind.alias("action"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    # --- places and prices ----------------------------------------------------
    def countries(self) -> DataFrame:
        n = self.raw("nation")
        return n.select(
            F.col("n_nationkey").alias("nation_key"),
            pick(NATION_CODES, F.col("n_nationkey")).alias("code"),
            F.col("n_name").alias("name"),
            F.col("n_regionkey").alias("region_key"),
        )

    def article_countries(self) -> DataFrame:
        """Bridge: an order's articles touch the nations of its suppliers."""
        li = self.raw("lineitem").select("l_orderkey", "l_suppkey")
        su = self.raw("supplier").select("s_suppkey", "s_nationkey")
        return (
            li.join(su, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.col("l_orderkey").alias("article_id"),
                pick(NATION_CODES, F.col("s_nationkey")).alias("country_code"),
            )
            .distinct()
        )

    def prices(self) -> DataFrame:
        """Raw price points: one per order, instrument = the customer's nation."""
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_nationkey").alias("instrument"),
            F.to_date("o_orderdate").alias("date"),
            F.col("o_orderkey").alias("seq"),
            F.when(F.col("o_orderkey") % 53 != 0, F.col("o_totalprice")).alias("close"),
        )

    def questions(self) -> DataFrame:
        """One archive question per benchmark passage, with a date phrase now and then."""
        i = F.col("item_id")
        phrase = (
            F.when(i % 8 == 1, F.lit(" today"))
            .when(i % 8 == 3, F.lit(" last week"))
            .when(i % 8 == 5, F.lit(" this month"))
            .otherwise(F.lit(""))
        )
        rule = F.when(i % 4 == 0, pick(list(lx.EXPANSION_RULES), F.floor(i / 4))).otherwise(F.lit(""))
        return self.raw("benchmark").select(
            i.alias("query_id"),
            F.col("text").alias("passage"),
            strip(F.concat(F.regexp_replace("text", r"\s+", " "), F.lit(" "), rule, phrase)).alias("question"),
            pick(lx.CATEGORIES, i).alias("category"),
        )
