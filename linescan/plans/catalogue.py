"""The queries of the search engine and their SQL."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescan.config import MAX_FILE_BYTES, SearchConfig
from linescan.functions import scalars
from linescan.functions.pattern import compile_pattern, grams
from linescan.operators import filters, ignore, index, output, stats
from linescan.operators import search as core
from linescan.sources import tables
from linescan.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
PARTS = ("the", "und", "der")
SEVERAL = "|".join(PARTS)
REGEX = "[Tt]h[a-z]+e"
DIGITS = "[0-9]+"
LOW_LIMIT = 4000
#: A table's texts are all searched, however long and whatever they hold; the filters have queries of their own.
ALL_FILES = {"size_filter": False, "binary_filter": False}
#: Ignore files of three directories of the paths of pages.
NESTED = [("", "9*\n/thther.example.org/en/1*\n"), ("thther.example.org", "*5\n!*25\n"), ("thther.example.org/en", "!*15\n7*\n")]

_DOCS = "(SELECT source || '/' || doc_id || '.txt' AS path, text FROM documents)"
_PAGES = "(SELECT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path, html AS text FROM pages)"


def _cut_sql(text: str, most: int) -> str:
    """The longest prefix of whole characters of at most that many bytes."""
    return f"CASE WHEN strlen({text}) <= {most} THEN {text} ELSE {text}[1:list_max(list_filter(range(0, {most} + 1), lambda i: strlen({text}[1:i]) <= {most}))] END"


def _lines_sql(files: str = _DOCS) -> str:
    return f"""(SELECT path, unnest(range(1, len(l) + 1))::INT AS line_num, unnest(l) AS text
      FROM (SELECT path, string_split(text, chr(10)) AS l FROM {files} WHERE strlen(text) > 0))"""


def _grep(pattern: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return core.search(tables.documents(spark, sf_dir), SearchConfig(pattern, **ALL_FILES | options), ranges=False)

    return run


def _grep_sql(test: str) -> str:
    return f"SELECT path, line_num, text FROM {_lines_sql()} WHERE {test}"


def _any_sql(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(text, '{x}')" for x in parts) + ")"


def _spans(pattern: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return core.span_rows(core.search(tables.documents(spark, sf_dir), SearchConfig(pattern, **ALL_FILES)))

    return run


def _spans_sql(pattern: str) -> str:
    return f"""
WITH hits AS (
  SELECT path, line_num, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g
  FROM {_lines_sql()} WHERE regexp_matches(text, '{pattern}')
),
each AS (SELECT path, line_num, m, g, unnest(range(1, len(m) + 1)) AS k FROM hits),
placed AS (
  SELECT path, line_num, strlen(m[k]) AS n,
         list_sum(list_transform(g[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: strlen(x))), 0) AS a
  FROM each
)
SELECT path, line_num, a::INT AS start_byte, (a + n)::INT AS end_byte FROM placed"""


def _docs(spark: SparkSession, sf_dir: str, pattern: str, **options) -> DataFrame:
    return core.search(tables.documents(spark, sf_dir), SearchConfig(pattern, **ALL_FILES | options))


def count_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.count_per_file(_docs(spark, sf_dir, REGEX))


def match_count_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "the").select("path", "line_num", F.size("ranges").alias("n_matches"))


def files_with_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.files_with_matches(_docs(spark, sf_dir, DIGITS))


def files_without_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.files_without_matches(tables.documents(spark, sf_dir), SearchConfig(DIGITS, **ALL_FILES))


def lines_not_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = compile_pattern("the")
    rows = core.lines(tables.documents(spark, sf_dir))
    return rows.where(~pattern.matches(F.col("line"))).select("path", "line_num", F.col("line").alias("text"))


def lines_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.search(tables.conversations(spark, sf_dir), SearchConfig("tion", **ALL_FILES), ranges=False)


def jump_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.match_lines(_docs(spark, sf_dir, DIGITS), root="/corpus").select("formatted")


def header_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.with_headers(_docs(spark, sf_dir, DIGITS), root="/corpus").select("formatted")


def truncated_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir, "the")
    return found.select("path", "line_num", scalars.truncated(F.col("text"), 500).alias("shown"))


def highlighted_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.match_lines(_docs(spark, sf_dir, DIGITS), jump=False, color=True, most=1 << 30).select("path", "line_num", "formatted")


def _low(pattern: str = "the", **options) -> SearchConfig:
    return SearchConfig(pattern, max_file_bytes=LOW_LIMIT, **options)


def filter_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.with_status(tables.documents(spark, sf_dir), _low())
    return rows.where(F.col("status") != "large").select("path", filters.size_of(rows).alias("size"))


def filter_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over pages, whose hosts and numbers stand for names; a binary extension is given to every third number."""
    return _named(spark, sf_dir, compat=False)


def filter_ext_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, compat=True)


def _named(spark: SparkSession, sf_dir: str, compat: bool) -> DataFrame:
    rows = tables.documents(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 3 == 0, ".png").when(F.col("doc_id") % 3 == 1, "/png").otherwise(".rs")
    named = rows.select(F.concat(F.col("doc_id").cast("string"), kind).alias("path"), "text")
    config = SearchConfig("the", compat_ext=compat)
    return filters.with_status(named, config).where("status = 'searched'").select("path")


def filter_binary_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose first 512 bytes have many control characters: made from documents by putting them for spaces."""
    rows = tables.documents(spark, sf_dir).withColumn("text", F.translate("text", " ", "\x01"))
    return filters.with_status(rows, SearchConfig("the")).select("path", "status")


def skip_common_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over conversations: a turn's number names the directory it is in."""
    rows = tables.conversations(spark, sf_dir)
    dirs = F.when(F.contains("path", F.lit("/0-")), "build/").when(F.contains("path", F.lit("/1-")), "src/target/").otherwise("src/")
    named = rows.withColumn("path", F.concat(dirs, "path"))
    return filters.with_status(named, SearchConfig("the").with_flags(everything=True)).where("status = 'searched'").select("path")


def _ignored(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = ignore.parse_rules(text)
        path = F.col("path")
        rows = tables.pages(spark, sf_dir)
        return rows.select("page_id", (ignore.pruned(rules, path) | ignore.ignored(rules, path, False)).alias("out"))

    return run


def ignore_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ignore.chain(NESTED)
    path = F.col("path")
    return tables.pages(spark, sf_dir).select("page_id", ignore.ignored(rules, path, False).alias("out"))


def _pages_sql(out: str) -> str:
    return f"""SELECT page_id, {out} AS out FROM (
      SELECT *, p[1] AS host, p[2] AS lang, regexp_extract(rtrim(path, '/'), '[^/]*$') AS name FROM (
        SELECT page_id, path, string_split(path, '/') AS p FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)))"""


def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ignore.parse_rules("*7.txt\n!src3/*\n/src2/\n")
    return stats.status_breakdown(tables.documents(spark, sf_dir), _low(), rules)


def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ignore.parse_rules("*7.txt\n/src2/\n")
    return stats.search_stats(tables.documents(spark, sf_dir), SearchConfig(DIGITS), rules)


def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stats_report(search_stats(spark, sf_dir))


def pattern_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every benchmark text as a pattern, which is many literals of different lengths."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.select("item_id", F.size(scalars.byte_grams(F.col("text"))).alias("n_fragments"))


def fragment_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of every distinct fragment of the part names."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(scalars.byte_grams(F.col("p_name"))).alias("gram")).distinct()
    return rows.select(F.hex("gram").alias("gram"), scalars.gram_hash(F.col("gram")).alias("hash"))


def stride_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.documents(spark, sf_dir)
    return rows.select("doc_id", scalars.stride(F.octet_length("text") * 64).alias("stride"))


def fragment_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.build(tables.documents(spark, sf_dir), grams("license"))
    return rows.select("path", F.hex("gram").alias("gram"), "present")


def _index(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    return index.build(tables.documents(spark, sf_dir), index.pattern_grams(compile_pattern(pattern)))


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index(spark, sf_dir, "License|example")
    return rows.groupBy("path").agg(F.count_if("present").alias("n_present"), F.count_if(~F.col("present")).alias("n_absent"))


def index_skip_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.skippable(_index(spark, sf_dir, "License|example"), tables.documents(spark, sf_dir), compile_pattern("License|example"))


def _with_index(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    files = tables.documents(spark, sf_dir)
    skip = index.skippable(_index(spark, sf_dir, pattern), files, compile_pattern(pattern))
    return core.search(files, SearchConfig(pattern, **ALL_FILES), skip=skip, ranges=False)


def grep_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_index(spark, sf_dir, "License")


def grep_with_index_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An escape, an optional letter and a class; the index may use what is left."""
    return _with_index(spark, sf_dir, r"\x4ci?cens[e\x73]")


def index_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of one version of the files against another, in which every fifth has grown."""
    files = tables.documents(spark, sf_dir)
    later = files.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" License"))).otherwise(F.col("text")))
    return index.outcome(_index(spark, sf_dir, "License"), later, compile_pattern("License"))


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds for different patterns; the second finds every fifth file changed."""
    files = tables.documents(spark, sf_dir)
    later = files.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" grown"))).otherwise(F.col("text")))
    both = index.upserted(index.build(files, grams("Licens")), index.build(later, grams("icense")))
    return both.groupBy("path", "size").agg(F.count("*").alias("n_grams"), F.count_if("present").alias("n_present"))


def diff_two_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and lines that only one of two patterns finds, both ways."""
    a, b = (_grep(p)(spark, sf_dir).select("path", "line_num") for p in ("the", "that"))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def union_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (_grep(p)(spark, sf_dir).select("path", "line_num") for p in ("the", DIGITS))
    return a.union(b).distinct()


def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.documents(spark, sf_dir).select("doc_id", F.octet_length("text").cast("bigint").alias("n"))
    shown = [scalars.format_bytes(F.col("n") * scale).alias(f"x{scale}") for scale in (1, 1000, 1000000)]
    return rows.select("doc_id", *shown)


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.pages(spark, sf_dir).select("page_id", F.concat(F.lit("/"), F.col("path")).alias("path"))
    path = F.col("path")
    return rows.select(
        "page_id",
        scalars.path_parent(path).alias("parent"),
        scalars.path_parent(scalars.path_parent(scalars.path_parent(path))).alias("top"),
        scalars.file_name(path).alias("name"),
    )


def directory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files directly in each directory."""
    rows = tables.pages(spark, sf_dir)
    return rows.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.count("*").alias("n_files"))


def _folder(spark: SparkSession, name: str) -> str:
    """A folder all executors reach: below spark.checkpoint.dir, or a temporary one of a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/linescan/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
    import atexit

    at = tempfile.mkdtemp(prefix="linescan-")
    atexit.register(shutil.rmtree, at, True)
    return os.path.join(at, name)


def stream_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch search as a stream over the documents' files, all that there are now."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    source = f"{sf_dir}/documents.parquet"
    source = source if os.path.isdir(source) else f"{sf_dir}/[d]ocuments.parquet"
    rows = spark.readStream.schema(schema).parquet(source)
    files = rows.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    found = stream.search_stream(files, SearchConfig("the", **ALL_FILES)).select("path", "line_num", "text")
    out, at = _folder(spark, "stream-out"), _folder(spark, "stream-state")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, line_num int, text string").parquet(out)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in events by hour of event time, with a watermark; complete, since nothing here comes late by a year."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = f"{sf_dir}/events.parquet"
    source = source if os.path.isdir(source) else f"{sf_dir}/[e]vents.parquet"
    files = tables.events(spark.readStream.schema(schema).parquet(source))
    found = stream.search_stream(files, SearchConfig("[0-9]", **ALL_FILES), keep=["path", "ts"])
    counted = stream.match_counts(found, "1 hour", "365 days")
    name = f"linescan_{uuid.uuid4().hex}"
    query = counted.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _folder(spark, "windows")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


_THE = "contains(text, 'the')"
_HITS = f"regexp_matches(text, '{DIGITS}')"
_LOW_DOCS = f"(SELECT *, strlen(text) AS size FROM (SELECT doc_id, source, source || '/' || doc_id || '.txt' AS path, text FROM documents))"
_GRAM_SQL = "list_distinct(list_transform(range(1, greatest(length(h) // 2 - 2, 1)), lambda i: h[2*i-1:2*i+6]))"


def _rule_sql(last_first: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in last_first) + " ELSE false END"


_SEARCH = {
    "grep_literal": (_grep("the"), _grep_sql(_THE)),
    "grep_multi_literal": (_grep(SEVERAL), _grep_sql(_any_sql(PARTS))),
    "grep_regex": (_grep(REGEX), _grep_sql(f"regexp_matches(text, '{REGEX}')")),
    "grep_regex_digits": (_grep(DIGITS), _grep_sql(_HITS)),
    "grep_regex_escape": (_grep(r"\x74he [a-z]"), _grep_sql("regexp_matches(text, 'the [a-z]')")),
    "grep_regex_class": (_grep(r"[\]\x5BTt]h[e\u0061]t*"), _grep_sql("regexp_matches(text, '[\[\]Tt]h[ea]')")),
    "grep_force_literal": (_grep(".", force_literal=True), _grep_sql("contains(text, '.')")),
    "grep_anchor_stripped": (_grep("^the$"), _grep_sql(_THE)),
    "grep_empty_pattern": (_grep("^$"), _grep_sql("true")),
    "grep_mixed_alternation": (_grep("the|[0-9]+x"), _grep_sql("regexp_matches(text, 'the|[0-9]+x')")),
    "grep_compat_alternation": (_grep("that|[0-9]+", compat_alternation=True), _grep_sql("contains(text, 'that')")),
    "grep_absent": (_grep("TODO"), _grep_sql("contains(text, 'TODO')")),
    "match_spans_literal": (_spans("the"), _spans_sql("the")),
    "match_spans_regex": (_spans(REGEX), _spans_sql(REGEX)),
    "match_spans_multi": (_spans(SEVERAL), _spans_sql(SEVERAL)),
    "match_count_per_line": (match_count_per_line, f"SELECT path, line_num, len(regexp_extract_all(text, 'the'))::INT AS n_matches FROM {_lines_sql()} WHERE {_THE}"),
    "match_count_per_file": (
        count_per_file,
        f"SELECT path, count(*) AS n_lines, sum(len(regexp_extract_all(text, '{REGEX}')))::BIGINT AS n_matches FROM {_lines_sql()} WHERE regexp_matches(text, '{REGEX}') GROUP BY path",
    ),
    "files_with_matches": (files_with_matches, f"SELECT DISTINCT path FROM {_lines_sql()} WHERE {_HITS}"),
    "files_without_match": (files_without_matches, f"SELECT path FROM {_DOCS} WHERE NOT {_HITS}"),
    "lines_not_matching": (lines_not_matching, _grep_sql(f"NOT {_THE}")),
    "grep_conversations": (
        lines_of_conversations,
        f"SELECT * FROM {_lines_sql("(SELECT conv_id || '/' || turn || '-' || role || '.txt' AS path, text FROM conversations)")} WHERE contains(text, 'tion')",
    ),
}
_OUTPUT = {
    "jump_format": (jump_format, f"SELECT '/corpus/' || path || ':' || line_num || ': ' || {_cut_sql('text', 500)} AS formatted FROM {_lines_sql()} WHERE {_HITS}"),
    "header_format": (
        header_format,
        f"""SELECT CASE WHEN row_number() OVER (PARTITION BY path ORDER BY line_num) = 1 THEN '/corpus/' || path || ':' || chr(10) ELSE '' END
        || line_num || ': ' || {_cut_sql("text", 500)} AS formatted FROM {_lines_sql()} WHERE {_HITS}""",
    ),
    "truncated_display": (truncated_display, f"SELECT path, line_num, {_cut_sql('text', 500)} AS shown FROM {_lines_sql()} WHERE {_THE}"),
    "highlighted_display": (
        highlighted_display,
        f"""SELECT path, line_num, chr(27) || '[1;36m' || line_num || chr(27) || '[0m: ' || regexp_replace(text, '({DIGITS})', chr(27) || '[1;31m\\1' || chr(27) || '[0m', 'g') AS formatted
        FROM {_lines_sql()} WHERE {_HITS}""",
    ),
}
_FILTERS = {
    "filter_size": (filter_size, f"SELECT path, size::BIGINT AS size FROM {_LOW_DOCS} WHERE size <= {LOW_LIMIT}"),
    "filter_ext": (filter_ext, "SELECT doc_id || CASE doc_id % 3 WHEN 1 THEN '/png' ELSE '.rs' END AS path FROM documents WHERE doc_id % 3 <> 0"),
    "filter_ext_compat": (filter_ext_compat, "SELECT doc_id || CASE doc_id % 3 WHEN 0 THEN '.png' ELSE '.rs' END AS path FROM documents WHERE doc_id % 3 <> 1"),
    "filter_binary_probe": (
        filter_binary_probe,
        f"""SELECT path, CASE WHEN len(head) - len(replace(head, ' ', '')) > 51 THEN 'binary_probe' ELSE 'searched' END AS status
        FROM (SELECT path, {_cut_sql("text", 512)} AS head FROM {_DOCS})""",
    ),
    "skip_common_dirs": (
        skip_common_dirs,
        "SELECT 'src/' || conv_id || '/' || turn || '-' || role || '.txt' AS path FROM conversations WHERE turn NOT IN (0, 1)",
    ),
    "ignore_literal": (_ignored("en\n"), _pages_sql("list_contains(p, 'en')")),
    "ignore_anchored": (_ignored("/thther.example.org/en\n"), _pages_sql("path = 'thther.example.org/en' OR starts_with(path, 'thther.example.org/en/')")),
    "ignore_glob": (_ignored("?1*\n[5-7]*\n1[!0-4]\n"), _pages_sql("len(list_filter(p, lambda x: regexp_matches(x, '^(.1.*|[5-7].*|1[^0-4])$'))) > 0")),
    "ignore_negation": (_ignored("*5\n!*25\n"), _pages_sql("len(list_filter(p, lambda x: ends_with(x, '5') AND NOT ends_with(x, '25'))) > 0")),
    "ignore_dir_only": (_ignored("**/en/\n"), _pages_sql("list_contains(p[1:len(p)-1], 'en')")),
    "ignore_chain": (
        ignore_chain,
        _pages_sql(
            _rule_sql([
                ("starts_with(path, 'thther.example.org/en/') AND starts_with(name, '7')", "true"),
                ("starts_with(path, 'thther.example.org/en/') AND ends_with(name, '15')", "false"),
                ("starts_with(path, 'thther.example.org/') AND ends_with(name, '25')", "false"),
                ("starts_with(path, 'thther.example.org/') AND ends_with(name, '5')", "true"),
                ("starts_with(path, 'thther.example.org/en/1')", "true"),
                ("starts_with(name, '9')", "true"),
            ])
        ),
    ),
    "status_breakdown": (
        status_breakdown,
        f"""SELECT status, count(*) AS n_files, sum(size)::BIGINT AS n_bytes FROM (
          SELECT size, CASE WHEN source = 'src2' THEN 'in_ignored_dir' WHEN size > {LOW_LIMIT} THEN 'large'
            WHEN source <> 'src3' AND doc_id % 10 = 7 THEN 'ignored' ELSE 'searched' END AS status FROM {_LOW_DOCS}) GROUP BY status""",
    ),
    "search_stats": (
        search_stats,
        f"""WITH s AS (SELECT *, CASE WHEN source = 'src2' THEN 'dir' WHEN size > {MAX_FILE_BYTES} THEN 'large' WHEN doc_id % 10 = 7 THEN 'ignored' ELSE 'searched' END AS status FROM {_LOW_DOCS})
        SELECT count(*) FILTER (WHERE status <> 'dir') AS files_encountered, count(*) FILTER (WHERE status = 'searched') AS files_searched,
          count(*) FILTER (WHERE status = 'searched' AND {_HITS}) AS files_contained_matches, count(*) FILTER (WHERE status = 'large') AS files_skipped_large,
          0::BIGINT AS files_skipped_as_binary_due_to_ext, 0::BIGINT AS files_skipped_as_binary_due_to_probe, 0::BIGINT AS files_skipped_unreadable,
          count(*) FILTER (WHERE status = 'ignored') AS files_skipped_gitignore, 0::BIGINT AS files_skipped_by_cache, 0::BIGINT AS symlinks_followed,
          0::BIGINT AS symlinks_broken, coalesce(sum(size) FILTER (WHERE status = 'searched'), 0)::BIGINT AS bytes_searched,
          count(DISTINCT source) FILTER (WHERE status <> 'dir') + 1 AS dirs_encountered, 0::BIGINT AS dirs_skipped_common,
          count(DISTINCT source) FILTER (WHERE status = 'dir') AS dirs_skipped_gitignore FROM s""",
    ),
    "stats_report": (stats_report, None),
}
_INDEX = {
    "pattern_fragments": (pattern_fragments, f"SELECT item_id, (CASE WHEN length(h) < 8 THEN 0 ELSE len({_GRAM_SQL}) END)::INT AS n_fragments FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark)"),
    "fragment_hash": (
        fragment_hash,
        f"""SELECT gram, ((('0x' || gram[7:8] || gram[5:6] || gram[3:4] || gram[1:2])::HUGEINT * {scalars.GRAM_FACTOR}) % 4294967296)::BIGINT AS hash
        FROM (SELECT DISTINCT unnest({_GRAM_SQL}) AS gram FROM (SELECT hex(encode(p_name)) AS h FROM part) WHERE length(h) >= 8)""",
    ),
    "stride_heuristic": (stride_heuristic, "SELECT doc_id, (CASE WHEN strlen(text) * 64 > 1048576 THEN 64 WHEN strlen(text) * 64 > 65536 THEN 8 ELSE 1 END)::INT AS stride FROM documents"),
    "fragment_presence": (
        fragment_presence,
        f"SELECT path, hex(encode(g)) AS gram, contains(text, g) AS present FROM {_DOCS}, (SELECT unnest(['lice', 'icen', 'cens', 'ense']) AS g)",
    ),
    "index_build": (
        index_build,
        f"""SELECT path, count(*) FILTER (WHERE contains(text, g)) AS n_present, count(*) FILTER (WHERE NOT contains(text, g)) AS n_absent
        FROM {_DOCS}, (SELECT unnest(['Lice', 'icen', 'cens', 'ense', 'exam', 'xamp', 'ampl', 'mple']) AS g) GROUP BY path""",
    ),
    "index_skip_set": (
        index_skip_set,
        f"""SELECT path FROM {_DOCS} WHERE len(list_filter(['Lice', 'icen', 'cens', 'ense'], lambda g: NOT contains(text, g))) > 0
        AND len(list_filter(['exam', 'xamp', 'ampl', 'mple'], lambda g: NOT contains(text, g))) > 0""",
    ),
    "grep_with_index_regex": (grep_with_index_regex, _grep_sql("regexp_matches(text, 'Li?cens[es]')")),
    "grep_with_index": (grep_with_index, _grep_sql("contains(text, 'License')")),
    "index_invalidation": (
        index_invalidation,
        """SELECT count(*) FILTER (WHERE doc_id % 5 <> 0 AND lacks) AS hits, count(*) FILTER (WHERE doc_id % 5 <> 0) AS known,
        count(*) FILTER (WHERE doc_id % 5 = 0) AS stale, 0::BIGINT AS unknown
        FROM (SELECT doc_id, len(list_filter(['Lice', 'icen', 'cens', 'ense'], lambda g: NOT contains(text, g))) > 0 AS lacks FROM documents)""",
    ),
    "index_upsert": (
        index_upsert,
        f"""SELECT path, size::BIGINT AS size, len(g) AS n_grams, len(list_filter(g, lambda x: contains(text, x))) AS n_present FROM (
          SELECT path, CASE WHEN doc_id % 5 = 0 THEN text || ' grown' ELSE text END AS text, size + CASE WHEN doc_id % 5 = 0 THEN 6 ELSE 0 END AS size,
            CASE WHEN doc_id % 5 = 0 THEN ['icen', 'cens', 'ense'] ELSE ['Lice', 'icen', 'cens', 'ense'] END AS g FROM {_LOW_DOCS})""",
    ),
}
_OTHER = {
    "diff_two_patterns": (
        diff_two_patterns,
        f"""WITH a AS (SELECT path, line_num FROM {_lines_sql()} WHERE {_THE}), b AS (SELECT path, line_num FROM {_lines_sql()} WHERE contains(text, 'that'))
        SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    ),
    "union_patterns": (
        union_patterns,
        f"SELECT path, line_num FROM {_lines_sql()} WHERE {_THE} UNION SELECT path, line_num FROM {_lines_sql()} WHERE {_HITS}",
    ),
    "format_bytes": (
        format_bytes,
        "SELECT doc_id, "
        + ", ".join(
            f"""CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0)
            WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0) ELSE n || ' B' END AS x{scale}""".replace("n ", f"(n * {scale}) ")
            for scale in (1, 1000, 1000000)
        )
        + " FROM (SELECT doc_id, strlen(text) AS n FROM documents)",
    ),
    "path_functions": (
        path_functions,
        """SELECT page_id, regexp_extract(regexp_replace(path, '/$', ''), '^(.*)/[^/]*$', 1) AS parent, '/' AS top, regexp_extract(rtrim(path, '/'), '[^/]*$') AS name
        FROM (SELECT page_id, '/' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)""",
    ),
    "directory_counts": (directory_counts, f"SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS n_files FROM {_PAGES} GROUP BY dir"),
    "stream_grep": (stream_grep, _grep_sql(_THE)),
    "stream_windows": (
        stream_windows,
        """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, sum(l)::BIGINT AS n_lines, sum(m)::BIGINT AS n_matches
        FROM (SELECT ts, len(list_filter(string_split(props, chr(10)), lambda x: regexp_matches(x, '[0-9]'))) AS l, len(regexp_extract_all(props, '[0-9]')) AS m FROM events)
        WHERE l > 0 GROUP BY ALL""",
    ),
}
_ALL = _SEARCH | _OUTPUT | _FILTERS | _INDEX | _OTHER


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
