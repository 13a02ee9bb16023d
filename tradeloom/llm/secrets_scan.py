"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern in every text: assignments of password-like keys, access keys,
long hexadecimal runs (the base kinds), and other opaque runs of 20 or more characters that hold
a letter and a digit. Each candidate value is hashed, and the hashes are aggregated by distinct
repositories and owners over the whole corpus. A value that at least `many` owners hold is a
widely copied example; one that fewer hold, and that does not look like a placeholder, is an
owner-specific live-looking credential. Base spans are always reported; opaque runs are
reported when they look live and touch no base span.

`source` is the repository; what stands before its first "/" is the owner. A null source counts
as one unknown owner. Null and empty texts have no spans. Repeated rows each get a row. Texts of
any length are scanned whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.llm.tasks import written

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Whole runs only: a shorter run holds no match of the required length either.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
_RUN_START = r"(?<![A-Za-z0-9+/_=-])"  # saves trying every suffix of a run
_HEX_START = r"(?<![0-9a-f])"

KINDS = ("assign", "access", "hex", "opaque")
PLACEHOLDER = "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee]|[Cc][Hh][Aa][Nn][Gg][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Xx]{4}|[Yy][Oo][Uu][Rr]"
MIN_VARIETY = 6  # distinct characters of a live-looking value


def _found(text: Column, kind: int, pattern: str, group: int) -> Column:
    """Matches of one kind: their index, what stands between them, length and hashed value."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))

    def one(part: Column, index: Column) -> Column:
        value = part["value"]
        enough = {0: F.char_length(value) >= 6, 3: value.rlike("[0-9]") & value.rlike("[A-Za-z]")}
        variety = F.size(F.array_distinct(F.split(value, "")))
        return F.struct(
            F.lit(kind).alias("kind"),
            index.alias("index"),
            part["gap"].cast("long").alias("gap"),
            F.char_length(part["hit"]).cast("long").alias("size"),
            enough.get(kind, F.lit(True)).alias("valid"),
            F.sha2(value.cast("binary"), 256).alias("hash"),
            ((variety >= MIN_VARIETY) & ~value.rlike(PLACEHOLDER)).alias("looks_live"),
        )

    whole = F.filter(F.transform(parts, one), lambda p: p["size"].isNotNull())
    return F.when(text.rlike(pattern), whole)


def candidates(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, source, found): all pattern matches per row, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [(ASSIGN, 2), (ACCESS, 0), (_HEX_START + HEX, 0), (_RUN_START + OPAQUE, 0)]
    found = [_found(text, k, pattern, group) for k, (pattern, group) in enumerate(kinds)]
    # The row number is frozen by writing the rows: it tells repeated doc_ids apart.
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        *[f.alias(f"_k{k}") for k, f in enumerate(found)],
    )
    none = F.expr("filter(_k0, x -> false)")
    lists = [F.coalesce(F.col(f"_k{k}"), F.coalesce(none, F.expr("array()"))) for k in range(4)]
    return written(rows.select("_row", "doc_id", "source", F.concat(*lists).alias("found")), "secrets")


def spans(rows: DataFrame) -> DataFrame:
    """(_row, source, kind, start, end, hash, looks_live): valid spans; opaque ones apart from base ones."""
    one = rows.where(F.size("found") > 0).select("_row", "source", F.explode("found").alias("f"))
    one = one.select("_row", "source", "f.*")
    through = Window.partitionBy("_row", "kind").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(through)
    placed = one.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where("valid")
    base = F.col("kind") < 3
    before = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    apart = placed.withColumn("reach", F.max(F.when(base, F.col("end"))).over(before)).withColumn(
        "next", F.min(F.when(base, F.col("start"))).over(after)
    )
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return apart.where(base | clear).select("_row", "source", "kind", "start", "end", "hash", "looks_live")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) over the corpus; copies collapse before the shuffle."""
    owner = F.substring_index("source", "/", 1)
    repos = found.groupBy("hash", "source").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("hash", owner.alias("owner")).agg(F.count("*").alias("repos"))
    return owners.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, many: int = 3) -> DataFrame:
    """Per row: doc_id and spans (array of kind, start, end, hash, n_owners, n_repos, live)."""
    rows = candidates(docs)
    found = written(spans(rows), "spans")
    known = found.join(ownership(found), "hash")
    live = F.col("looks_live") & (F.col("n_owners") < many)
    reported = known.withColumn("live", live).where((F.col("kind") < 3) | F.col("live"))
    span = F.struct("start", "kind", "end", "hash", "n_owners", "n_repos", "live")
    listed = reported.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return rows.select("_row", "doc_id").join(listed, "_row", "left").select("doc_id", "spans")


def _names(spans_: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    name = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])
    return F.coalesce(F.array_join(F.transform(spans_, name), ","), F.lit(""))


def query(spark, folder: str, many: int = 3) -> DataFrame:
    rows = scan(spark.read.parquet(f"{folder}/documents.parquet"), many)
    count = lambda test: F.coalesce(F.size(F.filter("spans", test)), F.lit(0)).cast("long")
    base = _names(F.filter("spans", lambda s: s["kind"] < 3))
    return rows.select(
        "doc_id",
        count(lambda s: s["kind"] == 0).alias("n_assign"),
        count(lambda s: s["kind"] == 1).alias("n_access"),
        count(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        _names(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["n_owners"] >= many).alias("n_copied"),
    )


def _sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_kind(kind: int, pattern: str, group: int, valid: str) -> str:
    p = _sql_quote(pattern)
    return f"""
      SELECT doc_id, source, {kind} AS kind, i, hit, val AS value, gap, {valid} AS valid FROM (
        SELECT doc_id, source, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(vals) AS val,
               unnest(gaps[:len(hits)]) AS gap
        FROM (SELECT doc_id, source, regexp_extract_all(t, {p}, 0) AS hits,
                     regexp_extract_all(t, {p}, {group}) AS vals, string_split_regex(t, {p}) AS gaps
              FROM d WHERE regexp_matches(t, {p})))"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join([
    _sql_kind(0, ASSIGN, 2, "length(val) >= 6"),
    _sql_kind(1, ACCESS, 0, "true"),
    _sql_kind(2, HEX, 0, "true"),
    _sql_kind(3, OPAQUE, 0, "regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')"),
])}),
p AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e
  FROM m
), v AS (SELECT *, e - length(hit) AS s FROM p WHERE valid),
c AS (
  SELECT * FROM v WHERE kind < 3
     OR NOT EXISTS (SELECT 1 FROM v b WHERE b.doc_id = v.doc_id AND b.kind < 3 AND b.s < v.e AND v.s < b.e)
), o AS (
  SELECT value, count(DISTINCT split_part(source, '/', 1)) AS n_owners FROM c GROUP BY value
), r AS (
  SELECT c.*, n_owners, n_owners < 3 AND len(list_distinct(string_split(value, ''))) >= {MIN_VARIETY}
         AND NOT regexp_matches(value, {_sql_quote(PLACEHOLDER)}) AS live
  FROM c JOIN o USING (value)
), g AS (
  SELECT doc_id,
    count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind)
      FILTER (kind < 3) AS base,
    string_agg(['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (n_owners >= 3) AS n_copied
  FROM r WHERE kind < 3 OR live GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (doc_id)
"""
