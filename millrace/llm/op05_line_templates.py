"""Line dedup by log templates, with DataFrame functions only.

Lines are put in the leaves of a tree of fixed depth: by token count, then by the leading tokens. A token with a digit
is a variable everywhere. What else varies is decided by leaf and place: a token stays constant where a fixed share of
the leaf's lines have it in that place, the rest become wildcards. Both rules look at a token or at a share, never at a
number of lines alone, so a template comes out the same whether a hundred lines or a hundred million have it. Lines of
a template that recurs in enough documents are dropped from them; so are lines that recur as they stand.

The usual form of this tree reads lines one after another and compares each with the clusters so far, so its result
depends on their order. Counting tokens by place makes it a set of aggregations with one result.

Until a template is decided a line is a few numbers. Equal lines (tokens with a digit apart) are one kind; kinds, not
lines, go through the tree, and one line of each kind in a leaf that could hold a template has its tokens read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import hot_join, stash

LEADING = 2
#: Lines under so many tokens have no room for variables; they count as they stand.
MIN_TOKENS = 4
MIN_LINES = 3
MIN_DOCS = 3
#: A token is constant in its place if this share of the leaf's lines have it there.
SHARE_PERCENT = 20
#: Of a template's tokens at least this share is constant.
CONSTANT_PERCENT = 50
WILD = "<*>"
SPACE = r"[\x20\x09-\x0D]+"
#: A token with a digit, from its first character on; possessive, so that a token is looked at once.
VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
#: What is left of a line from its first token on.
SAID = r"[^\x20\x09-\x0D][^\n]*+"
#: A key with a 256th of all rows is hot; there are 256 at most.
HOT = 256
#: Kinds of a leaf that share one copy of its constants.
SALT_KINDS = 1000


def _masked(said: Column) -> Column:
    """A _plain line with its variables replaced; most lines have none and are only looked through."""
    return F.when(said.rlike("[0-9]"), F.regexp_replace(said, VARIABLE, WILD)).otherwise(said)


def _plain(said: Column) -> Column:
    """The tokens of a line, joined by single spaces; most lines are so already."""
    return F.btrim(F.when(said.rlike(r"\x20\x20|[\x09-\x0D]"), F.regexp_replace(said, SPACE, " ")).otherwise(said))


def _count(said: Column, token: str) -> Column:
    """How often a token of a _plain line equals the one given."""
    wide = F.concat(F.lit(" "), F.replace(said, F.lit(" "), F.lit("  ")), F.lit(" "))
    return ((F.octet_length(wide) - F.octet_length(F.replace(wide, F.lit(f" {token} "), F.lit("")))) / (len(token) + 2)).cast("int")


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """row, line, n, leaf and kind of every line with a token."""
    said = docs.select(_row().alias("row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "said"))
    plain = said.select("row", "line", _plain(F.col("said")).alias("said")).where("said != ''")
    masked = plain.withColumn("masked", _masked(F.col("said")))
    n = F.octet_length("said") - F.octet_length(F.replace("said", F.lit(" "), F.lit(""))) + 1
    counted = masked.withColumns({"n": n, "wild": _count(F.col("masked"), WILD)})
    fits = (F.col("n") >= MIN_TOKENS) & ((F.col("n") - F.col("wild")) * 100 >= F.col("n") * CONSTANT_PERCENT)
    return counted.select(
        "row", "line", "n",
        F.xxhash64("n", F.substring_index("masked", " ", LEADING)).alias("leaf"),
        F.when(fits, F.xxhash64(F.lit("masked"), "masked")).otherwise(F.xxhash64(F.lit("said"), "said")).alias("kind"),
    )


def recurring(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, line, kind of every line; the kinds to drop; the hot kinds)."""
    lines = stash(lines_of(docs), "lines")
    # A kind lies in one leaf. Documents are counted exactly; the rows of a kind in two documents are its first and last.
    kinds = stash(
        lines.groupBy("kind", "row").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("line"), F.first("leaf").alias("leaf"), F.first("n").alias("n"))
        .groupBy("kind").agg(
            F.count(F.lit(1)).alias("docs"), F.sum("lines").alias("lines"), F.min(F.struct("row", "line")).alias("at"), F.max("row").alias("last"),
            F.first("leaf").alias("leaf"), F.first("n").alias("n"),
        ),
        "kinds",
    )
    totals = kinds.agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("kinds")).first()
    hot = kinds.where(F.col("lines") * HOT >= (totals["lines"] or 0)).select("kind")
    as_they_stand = kinds.where(F.col("docs") >= MIN_DOCS).select("kind")
    return lines, as_they_stand.unionByName(generalised(docs, kinds, totals["kinds"])).distinct(), hot


def generalised(docs: DataFrame, kinds: DataFrame, total: int) -> DataFrame:
    """The kinds whose template, wildcards included, recurs in MIN_DOCS documents."""
    longer = kinds.where(F.col("n") >= MIN_TOKENS)
    # A leaf of one kind, or of lines of too few documents, has nothing to generalise; most prose ends here.
    leaves = longer.groupBy("leaf").agg(F.sum("lines").alias("leaf_lines"), F.count(F.lit(1)).alias("leaf_kinds"), F.sum("docs").alias("leaf_docs"))
    leaves = stash(leaves.where((F.col("leaf_kinds") > 1) & (F.col("leaf_docs") >= MIN_DOCS)), "leaves")
    crowded = hot_join(longer, leaves, "leaf", leaves.where(F.col("leaf_kinds") * HOT >= total))
    # One document of each kind is asked for the line; a document's list is bounded by its lines.
    numbers = ("leaf", "kind", "docs", "last", "n", "lines", "leaf_lines", "leaf_kinds")
    wanted = crowded.groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct(F.col("at.line").alias("line"), *numbers)).alias("wanted"))
    texts = docs.select(_row().alias("row"), F.split("text", "\n").alias("all"))
    asked = texts.join(wanted, "row").select("row", "all", F.explode("wanted").alias("w")).select("row", "w.*", F.get("all", F.col("w.line")).alias("said"))
    # Rows that are equal in doc_id and text answer twice; they are in the same partition, so this moves nothing.
    asked = asked.groupBy("row", "line", *numbers).agg(F.first("said").alias("said"))
    # A token with its place is one number, so a line never has one twice.
    placed = F.transform(F.split(_masked(_plain(F.col("said"))), " "), lambda t, i: F.when(t != WILD, F.xxhash64(i, t)))
    read = stash(asked.select("row", *numbers, F.array_compact(placed).alias("tokens")), "tokens")

    # The constants of a leaf: a few tokens for each place, since each has a share of the lines.
    enough = (F.col("n_lines") >= MIN_LINES) & (F.col("n_lines") * 100 >= F.col("leaf_lines") * SHARE_PERCENT)
    constant = (
        read.select("leaf", "leaf_lines", "leaf_kinds", "lines", F.explode("tokens").alias("token"))
        .groupBy("leaf", "leaf_lines", "leaf_kinds", "token").agg(F.sum("lines").alias("n_lines")).where(enough)
        .groupBy("leaf", "leaf_kinds").agg(F.collect_list("token").alias("constant"))
        .select("leaf", "constant", F.explode(F.sequence(F.lit(0), F.floor(F.col("leaf_kinds") / SALT_KINDS))).alias("salt"))
    )
    salted = read.withColumn("salt", F.pmod("kind", F.floor(F.col("leaf_kinds") / SALT_KINDS) + 1))
    shape = F.array_intersect("tokens", "constant")
    shaped = salted.join(constant, ["leaf", "salt"]).where(F.size(shape) * 100 >= F.col("n") * CONSTANT_PERCENT)
    shaped = stash(shaped.select("kind", "docs", "row", "last", F.xxhash64("leaf", shape).alias("template")), "templates")

    seen = shaped.select("template", "docs", F.explode(F.array("row", "last")).alias("row"))
    again = seen.groupBy("template", "row").agg(F.max("docs").alias("docs"), F.count(F.lit(1)).alias("times"))
    again = again.groupBy("template").agg(F.count(F.lit(1)).alias("rows"), F.max("docs").alias("docs"), F.sum("times").alias("times"))
    again = stash(again.where(F.greatest("rows", "docs") >= MIN_DOCS).select("template", "times"), "recurring")
    return hot_join(shaped, again, "template", again.where(F.col("times") * HOT >= 2 * shaped.count())).select("kind")


def drop_templates(docs: DataFrame) -> DataFrame:
    """docs with `text` less its recurring lines, and n_lines and n_dropped (lines with a token; those that went).

    A null text stays null, an empty one empty. Lines without a token are never dropped and don't count. Lines are
    compared by their tokens, so white space between them makes no difference. Texts may be of any length. Rows that are
    equal in doc_id and text count as one document, each as a row; rows that share a doc_id or have none count by their
    texts. An empty table gives no rows; columns named n_lines or n_dropped are replaced, all others stay.
    """
    lines, kinds, hot = recurring(docs)
    gone = hot_join(lines.select("row", "line", "kind"), kinds, "kind", hot).groupBy(F.col("row").alias("_row")).agg(F.collect_set("line").alias("_gone"))
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "text")]
    marked = docs.withColumn("_row", _row()).join(gone, "_row", "left")
    split = marked.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    return split.select(
        *kept_columns,
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")).alias("text"),
        F.coalesce(F.regexp_count("text", F.lit(SAID)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op5_line_templates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_templates(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, l[i] AS text, trim(regexp_replace(l[i], '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS said
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), range(1, 1 + len(l)) AS r(i)
), tokens AS (
  SELECT *, string_split(said, ' ') AS plain, string_split(regexp_replace(said, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS masked FROM lines WHERE said <> ''
), kinded AS (
  SELECT *, len(plain) AS n, masked[1:2] AS lead,
         CASE WHEN len(plain) >= 4 AND len(list_filter(masked, lambda t: t <> '<*>')) * 100 >= len(plain) * 50 THEN array_to_string(masked, ' ') END AS kind
  FROM tokens
), leafed AS (
  SELECT *, count(*) OVER (PARTITION BY n, lead) AS leaf_lines FROM kinded WHERE n >= 4
), crowded AS (
  SELECT * FROM leafed SEMI JOIN (SELECT n, lead FROM leafed GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3) USING (n, lead)
), placed AS (
  SELECT doc_id, line, n, lead, leaf_lines, r.pos, masked[r.pos] AS token FROM crowded, range(1, 1 + n) AS r(pos) WHERE masked[r.pos] <> '<*>'
), constant AS (
  SELECT n, lead, pos, token FROM placed GROUP BY ALL HAVING count(*) >= 3 AND count(*) * 100 >= any_value(leaf_lines) * 20
), shaped AS (
  SELECT doc_id, line, n, lead, string_agg(pos || ':' || token, ' ' ORDER BY pos) AS shape
  FROM placed SEMI JOIN constant USING (n, lead, pos, token) GROUP BY doc_id, line, n, lead HAVING count(*) * 100 >= n * 50
), gone AS (
  SELECT doc_id, line FROM shaped SEMI JOIN (SELECT n, lead, shape FROM shaped GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3) USING (n, lead, shape)
  UNION
  SELECT doc_id, line FROM kinded SEMI JOIN (SELECT kind FROM kinded GROUP BY kind HAVING count(DISTINCT doc_id) >= 3) USING (kind)
  UNION
  SELECT doc_id, line FROM kinded SEMI JOIN (SELECT said FROM kinded WHERE kind IS NULL GROUP BY said HAVING count(DISTINCT doc_id) >= 3) USING (said) WHERE kind IS NULL
)
SELECT lines.doc_id, count(*) FILTER (said <> '') AS n_lines, count(gone.line) AS n_dropped,
       md5(coalesce(string_agg(text, chr(10) ORDER BY lines.line) FILTER (gone.line IS NULL), '')) AS kept_md5
FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.line = gone.line
GROUP BY lines.doc_id
"""
