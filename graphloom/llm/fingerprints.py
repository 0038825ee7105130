"""Document fingerprints: bottom-k sketches of shingle hashes, by SQL functions alone.

The sketch of a text is the ``k`` least distinct XXH64 hashes (as signed numbers) of its shingles of five words; a text
of fewer words is one shingle, one without words none.  The sketch of a union is the ``k`` least of two sketches, so
sketches of parts (of a text, a partition, a corpus) merge in any order.  Of two sketches the ``k`` least values of the
union are a uniform sample of all shingles: the share of them that both have estimates resemblance.  The k-th least value
tells how dense the hashes lie and with it the number of distinct shingles; both together give containment.  Sketches
shorter than ``k`` hold every hash, and their figures are exact.

Words are split on ASCII white space with A-Z in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import ascii_lower, free_name

K = 128
SHINGLE = 5
SPAN = 2.0**64


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x09-\\x0D\\x20]+"), lambda w: w != "")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """The hash of every shingle: that of its words' hashes in order."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(size)]))
        short = F.when(n > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda s, x: F.xxhash64(s, x)))).otherwise(F.array().cast("array<long>"))
        return F.when(n >= size, each).otherwise(short)

    return F.element_at(F.transform(F.array(hashes), shingles), 1)  # binds the words' hashes, so they are taken once


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    return _least(shingle_hashes(text, size), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return _least(F.concat(a, b), k)


def merge_all(rows: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """``(keys, <sketch_col>)``: the merged sketch of each group, however large; a null sketch adds nothing.

    Hashes are made distinct before the shuffle, and each task hands on no more than the k least of a group.
    """
    each = rows.select(*keys, F.explode_outer(sketch_col).alias("hash")).distinct()
    least = each.withColumn("nth", F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.asc_nulls_last("hash")))).where(F.col("nth") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard similarity of the shingle sets, 0 to 1; two sets without shingles are alike."""

    def share(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(u, a), b))
        return F.when(F.size(u) > 0, both / F.size(u)).otherwise(F.lit(1.0))

    return F.element_at(F.transform(F.array(merge(a, b, k)), share), 1)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """How many distinct shingles: exact below k, else (k - 1) over the share of the range that the k least values span."""
    share = (F.element_at(a, -1).cast("double") + SPAN / 2 + 1) / SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has too, 0 to 1; nothing is contained in anything."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def to_text(a: Column) -> Column:
    """16 hex digits for each value."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _places(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds a key reaches: first among every so many of them, then among those in between."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(F.lit(bounds[::step]), lambda b: b <= key))
    fine = F.size(F.filter(F.slice(F.lit(bounds), (coarse - 1) * step + 1, F.lit(step)), lambda b: b <= key))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def with_next(docs: DataFrame, columns: list[str], rows: int = 4096, id_col: str = "doc_id", text_col: str = "text", most: int = 16_384) -> DataFrame:
    """Every row with ``next_<c>`` of the row after it in the order of id and text; the first follows the last.

    Ids are cut at their quantiles into ranges of about ``rows`` rows (a null id comes first), at most ``most`` of them, and
    each range is a task.  It also gets a copy of the rows that begin the next one, so a window over each range sees every
    successor.  The ranges' bounds and least ids, at most ``most`` numbers each, are all that the driver learns and
    broadcasts.  Rows that repeat an id are one range.  An empty table gives none.  A column that has the name of a new one
    is replaced; no other name clashes.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[f"next_{c}" for c in columns])
    key, place, head, ahead, at = (free_name(docs, c) for c in ("key", "place", "head", "ahead", "at"))
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))))
    ids = keyed.select(key)
    ranges = min(most, -(-ids.count() // rows))
    steps = ids.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("q")).first()["q"] if ranges > 1 else []
    dealt = keyed.withColumn(place, _places(F.col(key), sorted(set(steps or []))))
    heads = dealt.groupBy(place).agg(F.min(key).alias(head)).orderBy(place).collect()
    if not heads:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    guests = [(h[head], heads[k - 1][place], 1 if k else 2) for k, h in enumerate(heads)]
    met = dealt.join(F.broadcast(spark.createDataFrame(guests, f"{head} long, {ahead} int, {at} int")), F.col(key) == F.col(head), "left")
    turn = F.struct(F.col(place).alias("place"), F.lit(0).alias("lap"))
    guest = F.struct(F.col(ahead).alias("place"), F.col(at).alias("lap"))
    both = met.select(*docs.columns, key, F.explode(F.when(F.col(head).isNotNull(), F.array(turn, guest)).otherwise(F.array(turn))).alias(at)).withColumn(place, F.col(f"{at}.place"))
    order = Window.partitionBy(place).orderBy(F.col(f"{at}.lap"), key, text_col)
    spread = both.repartitionById(heads[-1][place] + 1, F.col(place))
    out = spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where(F.col(f"{at}.lap") == 0)
    return out.drop(key, place, at)


def edited(text: Column, following: Column) -> Column:
    """The text, its last quarter replaced by as many characters of the following text (or all it has)."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.left(text, n - quarter), F.left(following, quarter))


def document_fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles,
    edited_contained)`` for every row.

    A null text counts as empty: no characters, the fingerprint ''.  Two texts without words have the likeness 1.  Rows
    that repeat an id follow one another in the order of their texts, null ids come first, a table of one row is its own
    next; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = with_next(rows.withColumn("sketch", sketch(F.col("text"), k)), ["text", "sketch"])
    changed = own.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_sketch", sketch(F.col("edited"), k))
    return changed.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        to_text(F.col("sketch")).alias("fingerprint"),
        to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_contained"),
    )
