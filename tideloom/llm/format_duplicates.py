"""Duplicates hidden by formatting: Merkle-style digests of normalised records.

A record is a tree: the text, its labelled parts, and each part's letters and digits. Leaves are normalised (letters
and digits only, case folded), a prose text is one ordered leaf, a text made only of labelled parts is an unordered node
whose child digests are sorted before the node is hashed. Records are grouped by root digest together with the full
canonical form, which is the structural comparison that confirms the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.operators.graph import connected_components
from tideloom.runtime import cut

#: Between labelled parts: line breaks, bars and semicolons.
PART_BREAK = r"[\r\n  |;]+"
#: A labelled part: a label of letters and blanks, a colon, a value.
LABELLED = r"^[^\p{L}\p{N}:：]*\p{L}[\p{L}\p{M}\p{Cf}\p{Z}\s]{0,40}[:：].*[\p{L}\p{N}].*$"


def bare(text: Column) -> Column:
    """Letters and digits of `text` in order, case folded (through upper case; a sharp s is two s)."""
    return F.lower(F.upper(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""), "[ßẞ]", "ss")))


def canonical(text: Column) -> Column:
    """Struct `(flat, root, form)`: the ordered leaf, the root digest and the canonical form it digests."""
    parts = F.filter(F.split(text, PART_BREAK), lambda x: F.length(bare(x)) > 0)
    labelled = (F.size(parts) >= 2) & F.forall(parts, lambda x: x.rlike(LABELLED))
    leaves = F.array_sort(F.transform(parts, bare))
    form = F.when(labelled, F.concat(F.lit("{"), F.array_join(leaves, "\u0001"), F.lit("}"))).otherwise(bare(text))
    digest = F.when(labelled, F.md5(F.array_join(F.array_sort(F.transform(leaves, lambda x: F.md5(x))), ""))).otherwise(F.md5(form))
    return F.struct(bare(text).alias("flat"), digest.alias("root"), form.alias("form"), labelled.alias("labelled"))


def format_duplicates(docs: DataFrame, key: str, text: str, min_length: int = 30) -> DataFrame:
    """`(key, first_id, copies)` for every record of at least `min_length` letters and digits.

    `first_id` is the smallest key among the records of the same content, `copies` their number. Contents are the same
    if their letters and digits agree in order, or if both consist only of labelled parts that agree in any order, and
    this is carried on: a record whose part breaks were lost meets its class through the ordered form.

    Null keys and null texts are left out, shorter ones too; keys are expected once (take one row per key before);
    repeated rows of one key count as one; an empty table gives an empty result; other columns are ignored. Groups are
    combined before each shuffle, so one content may hold any share of all rows.
    """
    shaped = (
        docs.select(F.col(key).cast("long").alias("k"), canonical(F.col(text)).alias("c"))
        .where(F.col("k").isNotNull() & (F.length("c.flat") >= min_length))
        .select("k", F.struct(F.unhex(F.md5("c.flat")).alias("digest"), F.xxhash64("c.flat").alias("seal")).alias("flat"), F.unhex("c.root").alias("root"), F.col("c.form").alias("form"), F.col("c.labelled").alias("labelled"))
    )
    rows = cut(shaped)  # texts are normalised once
    # Records of equal digest and equal form; the smallest key stands for each.
    alike = cut(rows.groupBy("root", "form", "flat", "labelled").agg(F.min("k").alias("first"), F.count_distinct("k").alias("n")).select("flat", F.struct("root", F.xxhash64("form").alias("seal")).alias("root"), "labelled", "first", "n"))
    # An ordered form may be seen with and without its part breaks, or broken in several ways, and a labelled root in
    # several orders: a class is what is connected through equal ordered forms and equal labelled roots. Both kinds of
    # node go by the smallest key they hold, which lies in both nodes it names.
    flats = alike.groupBy("flat").agg(F.min("first").alias("src"), F.sum("n").alias("n"))
    labelled = alike.where("labelled")
    roots = labelled.groupBy("root").agg(F.min("first").alias("dst"))
    links = labelled.select("flat", "root").distinct().join(flats.select("flat", "src"), "flat").join(roots, "root").where("src <> dst").select("src", "dst")
    found = connected_components(links)
    named = flats.join(found.withColumnRenamed("id", "src"), "src", "left").select("flat", F.coalesce("component", "src").alias("first_id"), "n")
    whole = named.groupBy("first_id").agg(F.sum("n").alias("copies"))
    classes = cut(named.join(whole, "first_id").select("flat", "first_id", "copies"))
    single = classes.where("copies = 1").select(F.col("first_id").alias(key), "first_id", "copies")
    many = rows.select("k", "flat").join(classes.where("copies > 1"), "flat").select(F.col("k").alias(key), "first_id", "copies").distinct()
    return single.unionByName(many)
