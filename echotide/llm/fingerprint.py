"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph, the text between two line ends, is hashed to a wide vector: 144 lanes
of 20 bits, all filled, three to a word of 64 bits, and ten groups of 64 lanes of
16 bits.  The first group takes every paragraph, each further one the quarter of
the one before whose hash is least; a hash fills one lane of a group that takes it.
A document's fingerprint is the sum of its paragraphs' vectors, each lane modulo
the power of two of its width.  It does not depend on the order of the paragraphs,
equal texts have equal fingerprints, and paragraphs are inserted or deleted by
adding or subtracting their vectors.

The filled lanes decide equality.  Likeness compares the finest group of the others
that is not crowded (at most 56 lanes hold something in either fingerprint; the last,
if all are): the numbers of differing and of all paragraphs follow from the shares
of lanes that differ and that hold something, and likeness is 1 less their quotient,
an estimate of the share of distinct paragraphs that both texts have, as often.  It
is 1 for equal fingerprints and near 0 for texts without a common paragraph, up to
some 16 million paragraphs.

Defined results: a null text is the empty text, which is one empty paragraph;
rows with a null id follow all others and rows that repeat an id follow one
another in order of the first 8 characters, then a hash, of their texts; rows that
are equal in id and text stay in one range; in a table of one row the row follows
itself; an empty table gives an empty table; other columns are ignored.

Scale: fingerprints are native expressions over one row.  To find the next
document, ids alone are put in order and numbered; texts are shuffled once, to
ranges of neighbours, of which a broadcast row holds the first ids, 40 bytes for
each ``range_rows`` documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._order import placed

#: Words of three filled lanes each: lane i of a word stands from bit 21 i, with a spare bit above it for the carry.
DENSE, LANE_BITS = 48, 20
LANES = sum(((1 << LANE_BITS) - 1) << (LANE_BITS + 1) * i for i in range(3))
SPARSE, SPARSE_BITS = 64, 16
GROUPS, CROWDED = 10, 56


def _lane(root: Column, salt: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(root, F.lit(salt)), F.lit(modulus))


def paragraph_roots(text: Column) -> Column:
    """One digest for each paragraph."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: F.sha2(p.cast("binary"), 256))


def vector(roots: Column) -> Column:
    """The summed lanes of paragraphs given by their digests, the filled ones first."""
    zero = F.lit(0).cast("bigint")
    narrow = 1 << SPARSE_BITS

    def filled(i: int) -> Column:
        drawn = lambda r: F.xxhash64(r, F.lit(i)).bitwiseAND(F.lit(LANES))
        return F.aggregate(roots, zero, lambda total, r: (total + drawn(r)).bitwiseAND(F.lit(LANES)))

    dense = [filled(i) for i in range(DENSE)]
    least = 4 ** (GROUPS - 1)
    pairs = F.transform(
        roots,
        lambda r: F.struct(
            _lane(r, DENSE, SPARSE).alias("lane"),
            (_lane(r, DENSE + 1, narrow - 1) + 1).alias("value"),
            _lane(r, DENSE + 2, least).alias("rank"),
        ),
    )
    taken = F.transform(
        F.array(*[F.lit(least >> 2 * g).cast("bigint") for g in range(GROUPS)]),
        lambda bound: F.filter(pairs, lambda p: p["rank"] < bound),
    )
    lanes = F.sequence(zero, F.lit(SPARSE - 1).cast("bigint"))

    def filled_one(held: Column, lane: Column) -> Column:
        return F.aggregate(
            held,
            zero,
            lambda total, p: F.when(p["lane"] == lane, F.pmod(total + p["value"], F.lit(narrow))).otherwise(total),
        )

    sparse = F.flatten(
        F.transform(
            taken,
            lambda held: F.when(F.size(held) == 0, F.array_repeat(zero, SPARSE)).otherwise(
                F.transform(lanes, lambda lane: filled_one(held, lane))
            ),
        )
    )
    return F.concat(F.array(*dense), sparse)


def _moved(fingerprint: Column, roots: Column, sign: int) -> Column:
    change = F.arrays_zip(fingerprint.alias("a"), vector(roots).alias("b"))
    # less a lane is plus its complement and one, lane by lane
    ones = F.lit(sum(1 << (LANE_BITS + 1) * i for i in range(3)))
    less = lambda b: (F.lit(LANES) - b + ones).bitwiseAND(F.lit(LANES))
    dense = lambda x: (x["a"] + (x["b"] if sign > 0 else less(x["b"]))).bitwiseAND(F.lit(LANES))
    return F.transform(
        change, lambda x, i: F.when(i < DENSE, dense(x)).otherwise(F.pmod(x["a"] + sign * x["b"], F.lit(1 << SPARSE_BITS)))
    )


def inserted(fingerprint: Column, text: Column) -> Column:
    """The fingerprint, as lanes, with the paragraphs of ``text`` added."""
    return _moved(fingerprint, paragraph_roots(text), 1)


def deleted(fingerprint: Column, text: Column) -> Column:
    """The fingerprint, as lanes, with the paragraphs of ``text`` taken away."""
    return _moved(fingerprint, paragraph_roots(text), -1)


def as_hex(lanes: Column) -> Column:
    wide = F.transform(F.slice(lanes, 1, DENSE), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0"))
    narrow = F.transform(F.slice(lanes, DENSE + 1, GROUPS * SPARSE), lambda x: F.lpad(F.lower(F.hex(x)), SPARSE_BITS // 4, "0"))
    return F.concat(F.array_join(wide, ""), F.array_join(narrow, ""))


def _let(value: Column, body) -> Column:
    """What ``body`` makes of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints as lanes."""
    both = F.zip_with(
        F.slice(a, DENSE + 1, GROUPS * SPARSE),
        F.slice(b, DENSE + 1, GROUPS * SPARSE),
        lambda x, y: F.when((x == 0) & (y == 0), F.lit(0)).when(x == y, F.lit(1)).otherwise(F.lit(2)),
    )

    def counted(codes: Column) -> Column:
        held, differ = F.filter(codes, lambda x: x > 0), F.filter(codes, lambda x: x == 2)
        return F.struct(F.size(held).alias("held"), F.size(differ).alias("differ"))

    def counts(codes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: counted(F.slice(codes, g * SPARSE + 1, F.lit(SPARSE))))

    def finest(found: Column) -> Column:
        return F.coalesce(F.get(F.filter(found, lambda c: c["held"] <= CROWDED), F.lit(0)), F.element_at(found, -1))

    def fallen(lanes: Column) -> Column:
        """How many paragraphs fill so many lanes."""
        return -F.log(1 - F.least(lanes.cast("double"), F.lit(SPARSE - 0.5)) / SPARSE)

    def near(c: Column) -> Column:
        return F.when(c["held"] == 0, F.lit(0.0)).otherwise(1 - fallen(c["differ"]) / fallen(c["held"]))

    found = _let(both, lambda codes: _let(counts(codes), lambda held: _let(finest(held), near)))
    same_dense = F.slice(a, 1, DENSE) == F.slice(b, 1, DENSE)
    return F.when(same_dense, F.lit(1.0)).otherwise(found)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text (null as empty) and its fingerprint as lanes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("roots", paragraph_roots(F.col("text"))).select("doc_id", "text", vector(F.col("roots")).alias("lanes"))


def _rank(rows: DataFrame, range_rows: int) -> DataFrame:
    """One row: ``firsts``, the first (doc_id, head, tie) of each range of neighbours, and every so many of them."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("head"), F.col("tie")]
    at = placed(rows.select("doc_id", "head", "tie").distinct(), order)
    some = at.where(F.pmod("place", F.lit(range_rows)) == 0).select("place", F.struct("doc_id", "head", "tie").alias("first"))
    held = some.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "first"))), lambda s: s["first"]).alias("firsts"))
    step = (F.floor(F.sqrt(F.size("firsts").cast("double"))) + 1).cast("int")
    told = held.withColumn("step", step)
    return told.withColumn("coarse", F.filter("firsts", lambda _, i: F.pmod(i, F.col("step")) == 0))


def _not_after(first: Column) -> Column:
    """Whether the first of a range comes no later than the row."""
    same = first["doc_id"].eqNullSafe(F.col("doc_id"))
    before = F.when(F.col("doc_id").isNull(), first["doc_id"].isNotNull()).otherwise(F.coalesce(first["doc_id"] > F.col("doc_id"), F.lit(False)))
    head = (first["head"] < F.col("head")) | ((first["head"] == F.col("head")) & (first["tie"] <= F.col("tie")))
    return before | (same & head)


def with_next(rows: DataFrame, *, range_rows: int, carry: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for each column c of ``carry``: that of the row next in descending id, after the last the first's.

    Rows are doc_id and text.  Ids alone are put in order; every ``range_rows``-th is the first of a range, and these
    firsts, as one broadcast row, tell each row its range.  The first row of a range also goes to the one before.
    """
    told = rows.withColumns({"head": F.substring("text", 1, 8), "tie": F.xxhash64("text")})
    ranges = _rank(told, range_rows)
    met = told.join(F.broadcast(ranges))
    skipped = (F.size(F.filter("coarse", _not_after)) - 1) * F.col("step")
    home = skipped + F.size(F.filter(F.slice("firsts", skipped + 1, F.col("step")), _not_after)) - 1
    placed_rows = met.withColumn("home", home)
    own_first = F.get("firsts", F.col("home"))
    leads = own_first["doc_id"].eqNullSafe(F.col("doc_id")) & (own_first["head"] == F.col("head")) & (own_first["tie"] == F.col("tie"))
    own = F.struct(F.col("home").alias("range"), F.lit(0).alias("spare"))
    before = F.struct((F.col("home") - 1).alias("range"), F.lit(1).alias("spare"))
    around = F.struct((F.size("firsts") - 1).alias("range"), F.lit(2).alias("spare"))
    targets = F.when(leads & (F.col("home") == 0), F.array(own, around)).when(leads, F.array(own, before)).otherwise(F.array(own))
    names = [c for c in rows.columns]
    dealt = placed_rows.select(*names, "head", "tie", F.explode(targets).alias("target"))
    order = Window.partitionBy("target.range").orderBy(
        F.when(F.col("target.spare") == 2, 1).otherwise(0), F.col("doc_id").desc_nulls_last(), "head", "tie", "target.spare"
    )
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in carry]
    return dealt.select(*names, "target", *nexts).where("target.spare = 0").drop("target")


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 1000) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars/2) code points replaced by the
    first as many, or all, of the next document's.
    """
    rows = with_next(fingerprints(docs, id_col=id_col, text_col=text_col), range_rows=range_rows, carry=["text", "lanes"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    compared = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "lanes", "next_lanes", edited.alias("edited"))
    compared = compared.withColumn("roots", paragraph_roots(F.col("edited"))).withColumn("edited_lanes", vector(F.col("roots")))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("lanes")).alias("fingerprint"),
        as_hex(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
