"""Document fingerprints: Merkle trees over sections, paragraphs and sentences.

A document is cut at blank lines into sections, a section at line breaks into
paragraphs, a paragraph after ``.``, ``!`` or ``?`` into sentences.  A sentence's hash
is the SHA-256 of its text; every other node hashes its children's hashes, each
level under its own letter.  Nothing is dropped by a cut, so roots are equal
exactly if texts are, and two trees differ only on the branches above an edit:
``edits`` names the paragraphs.

Everything is DataFrame functions: trees are nested arrays, comparisons array
operations, neighbours a window inside ranges of doc_id.

Edge cases: a null text is the empty text (one section with one paragraph
without sentences); a single document is its own next one; repeated doc_ids are ordered by
the hash of their text; null doc_ids come last; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTENCES = "[^.!?]+[.!?]*|[.!?]+"
#: Ranges of doc_id for each shuffle partition, and quantiles that place them.
RANGES_EACH, QUANTILES = 8, 256


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``{name}_sentences``, ``_paragraphs``, ``_sections`` (hashes, nested
    by section and paragraph), ``{name}`` (the root) and ``{name}_nodes`` (all
    distinct hashes)."""
    leaf, paragraphs, sections = f"{name}_sentences", f"{name}_paragraphs", f"{name}_sections"

    def node(letter: str, children: Column) -> Column:
        return F.sha2(F.concat(F.lit(letter), F.array_join(children, "")), 256)

    def sentences(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(p, F.lit(SENTENCES), F.lit(0)), lambda s: F.sha2(F.concat(F.lit("t"), s), 256))

    cut = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n"), lambda s: F.transform(F.split(s, "\n"), sentences))
    return (df.withColumn(leaf, cut)
            .withColumn(paragraphs, F.transform(leaf, lambda s: F.transform(s, lambda p: node("p", p))))
            .withColumn(sections, F.transform(paragraphs, lambda s: node("s", s)))
            .withColumn(name, node("d", F.col(sections)))
            .withColumn(f"{name}_nodes", F.array_distinct(F.concat(
                F.flatten(F.flatten(leaf)), F.flatten(paragraphs), F.col(sections), F.array(name)))))


def likeness(a: str, b: str) -> Column:
    """Share of the two trees' distinct nodes that they have in common (twice
    the common ones over both counts); 1 exactly for equal texts."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def edits(a: str, b: str) -> Column:
    """(section, paragraph) positions whose hashes differ between two trees
    (names as given to ``with_tree``), found below differing sections only."""
    def below(i: Column, x: Column, y: Column) -> Column:
        pairs = F.arrays_zip(F.coalesce(x, F.array().cast("array<string>")).alias("x"),
                             F.coalesce(y, F.array().cast("array<string>")).alias("y"))
        marked = F.transform(pairs, lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p.x.eqNullSafe(p.y).alias("same")))
        return F.transform(F.filter(marked, lambda m: ~m.same), lambda m: F.struct(m.section, m.paragraph))

    tops = F.arrays_zip(F.col(f"{a}_sections").alias("x"), F.col(f"{b}_sections").alias("y"),
                        F.col(f"{a}_paragraphs").alias("px"), F.col(f"{b}_paragraphs").alias("py"))
    marked = F.transform(tops, lambda t, i: F.when(t.x.eqNullSafe(t.y), F.array().cast("array<struct<section:int,paragraph:int>>"))
                         .otherwise(below(i, t.px, t.py)))
    return F.flatten(marked)


def with_next(docs: DataFrame, add) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) after ``add`` (a function that adds
    columns to each row), with ``next``: the struct of the text and added
    columns of the next row by doc_id, the first row's after the last.

    Rows are dealt by ranges of doc_id, and the first rows of a range also go
    to the range before, so one shuffle of the texts is all.  Ranges are set by
    quantiles of doc_id and evenly cut between them; the only broadcast is one
    short row for each range, whose number follows the shuffle partitions."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("at", F.coalesce("doc_id", F.lit(2**63 - 1)))
    ids = keyed.select("at")
    found = ids.approxQuantile("at", [i / QUANTILES for i in range(QUANTILES + 1)], 0.001)
    cuts = sorted({min(int(c), 2**63 - 1) for c in found})
    cuts += [2**63 - 1] * (QUANTILES + 1 - len(cuts))
    each = -(-RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")) // QUANTILES)

    def reached(first: Column, step: int) -> Column:
        """How many of 15 cuts, ``step`` apart after ``first``, ids have reached."""
        return sum((F.col("at") >= F.get("cuts", first + F.lit(k * step))).cast("int") for k in range(1, 16))

    # A search in two steps of 16 for the quantile, then even ranges inside it.
    ranged = (keyed.withColumn("cuts", F.lit(cuts))
              .withColumn("coarse", 16 * reached(F.lit(0), 16))
              .withColumn("q", F.col("coarse") + reached(F.col("coarse"), 1))
              .withColumn("low", F.get("cuts", "q").cast("double"))
              .withColumn("share", (F.col("at") - F.col("low")) / F.greatest(F.get("cuts", F.expr("q + 1")) - F.col("low"), F.lit(1.0)))
              .withColumn("inside", F.least(F.greatest(F.floor(F.col("share") * each), F.lit(0)), F.lit(each - 1)))
              .select("doc_id", "text", "at", (F.col("q") * each + F.col("inside")).cast("bigint").alias("range")))
    heads = ranged.groupBy("range").agg(F.min("at").alias("head")).orderBy("range").collect()   # bounded, see above
    before = [(h.head, heads[i - 1].range, int(i == 0)) for i, h in enumerate(heads)]
    heads = F.broadcast(spark.createDataFrame(before, "head bigint, prior bigint, wrap int"))

    def place_in(target: Column, own: bool, wrap: Column) -> Column:
        return F.struct(target.alias("range"), F.lit(own).alias("own"), wrap.alias("wrap"))

    own = place_in(F.col("range"), True, F.lit(0))
    places = F.when(F.col("prior").isNull(), F.array(own)).otherwise(F.array(own, place_in(F.col("prior"), False, F.col("wrap"))))
    dealt = (ranged.join(heads, F.col("at") == F.col("head"), "left")
             .select("doc_id", "at", "text", F.explode(places).alias("p"))
             .select("doc_id", "at", "text", "p.range", "p.own", "p.wrap")
             .repartition("range"))
    added = add(dealt)
    extra = [c for c in added.columns if c not in dealt.columns]
    order = Window.partitionBy("range").orderBy("wrap", "at", F.xxhash64("text"), F.desc("own"))
    return (added.withColumn("next", F.lead(F.struct("text", *extra)).over(order))
            .where("own").select("doc_id", "text", *extra, "next"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text with the last half of its
    characters replaced by the next document's first ones, and the likeness of
    its fingerprint to that one and to the next document's.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edited_paragraphs (places that differ)."""
    keep = ["fingerprint", "fingerprint_nodes", "fingerprint_sections", "fingerprint_paragraphs"]

    def tree(df: DataFrame) -> DataFrame:
        return with_tree(df, "text", "fingerprint").select(*df.columns, *keep)

    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = with_next(docs, tree).withColumn("n_chars", F.length("text").cast("bigint"))
    edited = both.withColumn("edited_text", F.concat(
        F.expr("substring(text, 1, CAST(n_chars - floor(n_chars / 2) AS INT))"), F.substring(F.col("next.text"), 1, half)))
    edited = with_tree(edited, "edited_text", "edited_fingerprint").withColumn("next_nodes", F.col("next.fingerprint_nodes"))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint_nodes", "edited_fingerprint_nodes").alias("near_edited"),
        likeness("fingerprint_nodes", "next_nodes").alias("near_next"),
        F.size(edits("fingerprint", "edited_fingerprint")).cast("bigint").alias("n_edited_paragraphs"))


FINGERPRINT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n_chars,
             coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM d),
e AS (SELECT *, left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) AS edited FROM n),
l AS (SELECT doc_id, k, list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
             lambda p: list_transform(regexp_extract_all(p, '[^.!?]+[.!?]*|[.!?]+'), lambda x: sha256('t' || x)))) AS leaf
      FROM (SELECT doc_id, 'o' AS k, text AS t FROM e UNION ALL SELECT doc_id, 'e', edited FROM e
            UNION ALL SELECT doc_id, 'n', next_text FROM e)),
p AS (SELECT *, list_transform(leaf, lambda s: list_transform(s,
             lambda x: sha256('p' || coalesce(array_to_string(x, ''), '')))) AS para FROM l),
s AS (SELECT *, list_transform(para, lambda x: sha256('s' || array_to_string(x, ''))) AS sect FROM p),
r AS (SELECT *, sha256('d' || array_to_string(sect, '')) AS root FROM s),
t AS (SELECT doc_id, k, root, para, sect,
             list_distinct(flatten(flatten(leaf)) || flatten(para) || sect || [root]) AS nodes FROM r)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, o.root AS fingerprint, x.root AS edited_fingerprint,
       2 * len(list_intersect(o.nodes, x.nodes)) / (len(o.nodes) + len(x.nodes)) AS near_edited,
       2 * len(list_intersect(o.nodes, y.nodes)) / (len(o.nodes) + len(y.nodes)) AS near_next,
       len(list_filter(flatten(list_transform(range(1, 1 + greatest(len(o.para), len(x.para))), lambda i: list_transform(
           range(1, 1 + greatest(coalesce(len(o.para[i]), 0), coalesce(len(x.para[i]), 0))),
           lambda j: o.para[i][j] IS DISTINCT FROM x.para[i][j]))), lambda z: z)) AS n_edited_paragraphs
FROM e JOIN t o ON o.doc_id = e.doc_id AND o.k = 'o' JOIN t x ON x.doc_id = e.doc_id AND x.k = 'e'
JOIN t y ON y.doc_id = e.doc_id AND y.k = 'n'
"""
