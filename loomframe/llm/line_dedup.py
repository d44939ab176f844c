"""Repeated line runs from the suffix array of line-ID sequences, by distributed prefix doubling, by DataFrame operations only.

The corpus is one sequence of lines, document by document.  Level 0 ranks the positions by their line (the order of
lines is that of their hashes); level k + 1 sorts them by the pair of level-k ranks at the position and 2**k lines on.
The ranks of level k are the suffix array sorted by the first 2**k lines: positions of equal rank are the interval
whose longest common prefix has at least that many.  A position whose rank nothing else bears has its place for good
and falls out.  As the shortest runs that count have at most ``min_words`` lines, and longer common prefixes delete
nothing more, doubling ends after log2(min_words) levels, however long the copies are.

A run counts if it has at least ``min_words`` words.  For each line the shortest such runs that begin and that end
there are looked up: the ranks of two overlapping runs of the largest fitting level tell the interval of the run's length,
and the first position in an interval keeps it.  Overlapping later copies unite to the maximal repeated runs, which are deleted.

First positions are partial aggregates, only the different ranks are sorted, and both come back by joins of stored tables,
so that adaptive execution can split a line or passage that a third of the corpus shares.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, release

WIDE = "decimal(38,0)"


def _position(j):
    """Order of the corpus: id (null last), a hash of the text where ids repeat, line."""
    doc = F.coalesce(F.col("d").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")) * F.lit(str(1 << 62)).cast("decimal(19,0)")
    return (doc.cast(WIDE) + (F.pmod("k", F.lit(1 << 30)) * F.lit(1 << 32) + j).cast("decimal(20,0)")).cast(WIDE)


def _ranks(keys: DataFrame) -> DataFrame:
    """``keys``, all different, with ``rank``, their number in order from 0; ``release`` deletes what is stored for it."""
    stored = materialize(keys, "line-keys")
    ordered = stored.repartitionByRange(*keys.columns).sortWithinPartitions(*keys.columns)
    cut = materialize(ordered.withColumn("rank", F.monotonically_increasing_id()), "line-names")
    release(stored)
    part = F.shiftright("rank", 33)  # above it the number of the range, below that within it
    sums = cut.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    sums = sums.select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "n")
    out = cut.join(F.broadcast(sums), part == F.col("part"))
    out = out.select(*keys.columns, (F.col("rank").bitwiseAND((1 << 33) - 1) + F.col("upto") - F.col("n")).alias("rank"))
    out._loomframe_path = cut._loomframe_path
    return out


def _joined(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` of ranks that more positions share, with their own rank as ``name``; and the stored table of ranks."""
    pairs = pairs.where("next IS NOT NULL")
    names = _ranks(pairs.groupBy("name", "next").agg(F.count("*").alias("n")).where("n > 1").select("name", "next"))
    return pairs.join(names, ["name", "next"]).drop("name", "next").withColumnRenamed("rank", "name"), names


def _next(level: DataFrame, size: int) -> DataFrame:
    return level.withColumn("next", F.first("name").over(Window.partitionBy("d", "k").orderBy("j").rangeBetween(size, size)))


def doubled(level: DataFrame, size: int) -> DataFrame:
    """``(d, k, j, name)``: from ranks by ``size`` lines those by twice as many, of the positions that share theirs."""
    return _joined(materialize(_next(level, size), "line-pairs"))[0].select("d", "k", "j", "name")


def ahead(level: DataFrame, size: int) -> DataFrame:
    """``(d, k, j, name, next, at, hits)``, stored: the rank ``size`` lines on, and of the runs that begin here, ``at``, those under twice that long, with their end's rank."""
    level = _next(level, size)
    if size > 1:
        w = Window.partitionBy("d", "k").orderBy("j").rangeBetween(0, size - 1)
        level = level.withColumn("near", F.collect_list(F.struct("j", "name")).over(w))
        two = lambda r: F.get(F.filter("near", lambda x: x["j"] == F.col("j") + r["n"] - size), 0)["name"]
    else:
        two = lambda r: F.col("name")
    hits = F.transform(F.filter("at", lambda r: r["n"] < 2 * size), lambda r: F.struct(r["n"].alias("n"), r["first"].alias("first"), r["last"].alias("last"), two(r).alias("two")))
    out = level.select("d", "k", "j", "name", "next", F.filter("at", lambda r: r["n"] >= 2 * size).alias("at"), F.filter(hits, lambda r: r["two"].isNotNull()).alias("hits"))
    return materialize(out.where("next IS NOT NULL OR size(hits) > 0"), "line-pairs")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``(d, k, first, last)``: the maximal line runs, by line number from 0, that copy an earlier one.

    d is the id, k the XXH64 of the text.  Lines end at \\n and compare trimmed; blank lines are no part of the
    sequence and go with the lines around them; words are what single spaces separate.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {docs.schema[id_col].dataType.simpleString()}")
    numbered = F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x")))
    lines = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("t")).where("t != ''")
    lines = lines.select("d", "k", F.posexplode(F.filter(numbered, lambda s: s["x"] != "")).alias("j", "s"))
    x = F.col("s.x")
    lines = lines.select("d", "k", "j", F.col("s.i").alias("i"), F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w"))
    lines = materialize(lines, "line-all")
    # repeated rows are one document: they have the same positions
    seen = lines.groupBy("h1", "h2").agg(F.min(_position(F.col("j"))).alias("a"), F.max(_position(F.col("j"))).alias("b")).where("a != b")
    seen = _ranks(seen.select("h1", "h2"))
    # texts are dealt by document once for what follows, up to the first ranks ahead
    doc = Window.partitionBy("d", "k")
    level = lines.join(seen, ["h1", "h2"]).select("d", "k", "j", "i", "w", F.col("rank").alias("name"))
    level = level.withColumn("before", F.lag("j").over(doc.orderBy("j"))).where("before IS NULL OR before != j")
    c = level.withColumn("end", F.sum("w").over(doc.orderBy("j").rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("w"))
    onward = doc.orderBy("begin").rangeBetween(0, min_words - 1)
    behind = doc.orderBy("end").rangeBetween(-(min_words - 1), 0)

    def run(frame, name=None):
        s, e = F.min("j").over(frame), F.max("j").over(frame)
        whole = (F.sum("w").over(frame) >= min_words) & (e - s + 1 == F.count("*").over(frame))
        r = F.when(whole, F.struct((e - s + 1).cast("int").alias("n"), F.min("i").over(frame).alias("first"), F.max("i").over(frame).alias("last")))
        return F.struct(s.alias("j"), F.lit(name).cast("long").alias("name") if name is None else F.col(name).alias("name"), r.alias("r"))

    # the runs that begin and that end at a line, brought to the line where they begin
    runs = c.select("d", "k", run(onward, "name").alias("a"), run(behind).alias("b")).select("d", "k", F.explode(F.array("a", "b")).alias("x")).select("d", "k", "x.*")
    level = runs.where("name IS NOT NULL OR r IS NOT NULL").groupBy("d", "k", "j").agg(F.max("name").alias("name"), F.collect_set("r").alias("at"))

    found, size, pairs = [], 1, ahead(level, 1)
    release(lines, seen)
    while True:
        found.append(materialize(pairs.select("d", "k", F.col("j").alias("s"), F.col("name").alias("one"), F.inline("hits")), "line-named"))
        if pairs.select(F.max(F.size("at"))).first()[0] in (None, 0):
            break
        size *= 2
        level, names = _joined(pairs.drop("hits"))
        pairs, old = ahead(level, size), pairs
        release(old, names)
    release(pairs)
    # a run's length tells its level, so that ranks of different levels do not meet
    named = reduce(DataFrame.unionAll, found)
    first = materialize(named.groupBy("n", "one", "two").agg(F.min(_position(F.col("s"))).alias("p")), "line-first")
    out = named.join(first, ["n", "one", "two"]).where(_position(F.col("s")) != F.col("p")).select("d", "k", "first", "last")
    upto = F.max("last").over(doc.orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("new", F.when(F.col("first") <= upto + 1, 0).otherwise(1))
    out = out.withColumn("island", F.sum("new").over(doc.orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)))
    out = materialize(out.groupBy("d", "k", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island"), "line-deleted")
    release(first, *found)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, removed_col: str | None = None) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text_col``; see ``repeated_runs``.

    All rows and columns stay; a text of which nothing is left is empty.  ``removed_col``, if given, is added and
    holds the runs that went, as an array of (first, last).  Null and empty texts stay as they are.  The id must be
    an integer (else a TypeError at the call); null ids count as last; rows with equal id and text are one document
    and get equal results; lines and texts count whole at any length; an empty table gives no row; extra columns of
    any name are carried along.
    """
    d, k, gone = (free_name(docs, x) for x in ("doc", "key", "gone"))
    runs = repeated_runs(docs, id_col, text_col, min_words).groupBy(F.col("d").alias(d), F.col("k").alias(k)).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(gone))
    keep = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.exists(gone, lambda r: i.between(r["first"], r["last"])))
    # one plan at every size: texts are dealt by id once, whether or not the runs of a small corpus would fit a broadcast
    joined = docs.join(runs.hint("merge"), F.col(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(text_col) == F.col(k)), "left")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(keep, "\n"))
    cols = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if removed_col:
        cols.append(F.coalesce(gone, F.array().cast("array<struct<first:int,last:int>>")).alias(removed_col))
    return joined.select(*cols)


def op7_line_dedup(spark, sf_dir):
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), removed_col="runs")
    return out.select("doc_id", "text", F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1).cast("long").alias("lines_removed"))


OP7_SQL = """
WITH lines AS (SELECT doc_id, text, i, trim(x, ' ') AS x FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM (SELECT DISTINCT doc_id, text FROM documents))),
c AS (SELECT *, row_number() OVER d AS j, len(x) - len(replace(x, ' ', '')) + 1 AS w FROM lines WHERE trim(x, ' ') <> '' WINDOW d AS (PARTITION BY doc_id, text ORDER BY i)),
e AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, text ORDER BY j) AS fin FROM c),
r AS (SELECT doc_id, text, min(j) OVER a AS s, sum(w) OVER a AS n, string_agg(x, chr(10)) OVER a AS body, min(i) OVER a AS f, max(i) OVER a AS l FROM (SELECT *, fin - w AS beg FROM e) WINDOW a AS (PARTITION BY doc_id, text ORDER BY beg RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
 UNION SELECT doc_id, text, min(j) OVER a, sum(w) OVER a, string_agg(x, chr(10)) OVER a, min(i) OVER a, max(i) OVER a FROM e WINDOW a AS (PARTITION BY doc_id, text ORDER BY fin RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
g AS (SELECT doc_id, text, f, l FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS nth FROM (SELECT DISTINCT * FROM r WHERE n >= 50)) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(f, l + 1)) AS i FROM g),
kept AS (SELECT doc_id, text, string_agg(x, chr(10) ORDER BY i) AS t FROM (SELECT d.doc_id, d.text, unnest(string_split(d.text, chr(10))) AS x, unnest(range(len(string_split(d.text, chr(10))))) AS i FROM (SELECT DISTINCT doc_id, text FROM documents) d) z
 WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = z.doc_id AND g.text = z.text AND g.i = z.i) GROUP BY 1, 2),
cnt AS (SELECT doc_id, text, count(*) AS n FROM gone GROUP BY 1, 2)
SELECT d.doc_id, CASE WHEN d.text = '' THEN '' WHEN d.text IS NOT NULL THEN coalesce(k.t, '') END AS text, coalesce(cnt.n, 0) AS lines_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text LEFT JOIN cnt ON d.doc_id = cnt.doc_id AND d.text = cnt.text
"""
