"""Texts of varying length into containers of fixed capacity (problem 7).

Lengths in tokens are counted into a histogram (one row per length up to the capacity, so it is bounded whatever the number of texts). Best fit in
descending order of length runs over its counts: containers with equal free room form one class with a multiplicity, and one step fills many of
them. The plan is a list of slot ranges per length. Texts take the slots by their rank within their length; a length with many texts is ranked in
salted parts whose offsets come from the part counts.
"""

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pluvion.scratch import written
from pluvion.sources.tables import table

#: The public tokenizer's vocabulary, unless the session names another in ``SETTING``. The driver reads it and ships it with the job; it is never copied here.
TOKENIZER, SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.pluvion.tokenizer"
#: Fixed value: how that tokenizer splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of one length ranked in one task.
PART_ROWS = 50_000


def token_counts(docs: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """key, n_tokens. NULL and empty texts have 0 tokens. Strings of special tokens count as ordinary text."""
    spark = docs.sparkSession
    vocabulary = vocabulary or spark.conf.get(SETTING, TOKENIZER)
    name = vocabulary.rsplit("/", 1)[-1]
    spark.sparkContext.addFile(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({key: b[key], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b[text]]})

    return docs.select(key, text).mapInPandas(count, f"{key} {dict(docs.dtypes)[key]}, n_tokens int")


def plan(histogram: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first: (length, first rank, end rank, first container, texts per container, offset in the container).

    Ranks ``a`` to ``b`` of a length go to containers ``c``, ``c + 1``, ... with ``per`` texts in each, from ``offset`` on.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # distinct free rooms, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> [(first container, number of containers)]
    total = 0

    def put(room: int, first: int, number: int) -> None:
        if room > 0 and number > 0:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((first, number))

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, first = capacity, total
                number = -(-(count - rank) // (capacity // length))
                total += number
            per, left = room // length, count - rank
            full = min(number, left // per)
            if full:
                rows.append((length, rank, rank + full * per, first, per, capacity - room))
                put(room - per * length, first, full)
                rank += full * per
            rest = min(per, count - rank) if full < number else 0
            if rest:
                rows.append((length, rank, rank + rest, first + full, rest, capacity - room))
                put(room - rest * length, first + full, 1)
                rank += rest
            put(room, first + full + bool(rest), number - full - bool(rest))
    return rows


def pieces(sizes: DataFrame, capacities: dict[str, int], key: str) -> DataFrame:
    """bin_kind, key, piece, start_token, n_tokens, whole: a text over the capacity is cut into full pieces and a rest, any other is one piece."""
    kinds = F.array(*[F.struct(F.lit(k).alias("bin_kind"), F.lit(c).alias("cap")) for k, c in capacities.items()])
    rows = sizes.withColumn("_k", F.explode(kinds)).select("_k.bin_kind", "_k.cap", key, "n_tokens")
    number = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("cap"))).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("start_token", F.col("piece") * F.col("cap"))
    return rows.withColumn("n_tokens", F.least(F.col("cap"), F.col("n_tokens") - F.col("start_token"))).select("bin_kind", "cap", key, "piece", "start_token", "n_tokens")


def packed(sizes: DataFrame, capacities: dict[str, int], key: str) -> DataFrame:
    """bin_kind, container, key, piece, start_token, n_tokens, offset: the slot of every piece of every text in each kind of container.

    Pieces as long as the capacity have a container of their own; texts without tokens take no room and have NULL container. Rows with equal
    keys are texts of their own. No text is cut unless it alone exceeds the capacity.
    """
    items = pieces(sizes, capacities, key)
    placed = items.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < F.col("cap")))
    histogram = written(placed.groupBy("bin_kind", "cap", "n_tokens").agg(F.count("*").alias("n")), "histogram")

    def planned(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = plan(list(zip(pdf["n_tokens"].tolist(), pdf["n"].tolist())), int(pdf["cap"].iloc[0]))
        out = pd.DataFrame(rows, columns=["n_tokens", "a", "b", "first", "per", "offset"])
        out.insert(0, "bin_kind", pdf["bin_kind"].iloc[0])
        return out

    slots = histogram.groupBy("bin_kind").applyInPandas(planned, "bin_kind string, n_tokens int, a long, b long, first long, per int, offset int")
    slots = written(slots, "slots")
    part = F.pmod(F.xxhash64(key, "piece"), F.ceil(F.col("n") / PART_ROWS))
    same = ["bin_kind", "n_tokens"]
    salted = placed.join(histogram.drop("cap"), same).withColumn("part", part).drop("n", "cap")
    parts = salted.groupBy(*same, "part").agg(F.count("*").alias("m"))
    parts = written(parts.withColumn("base", F.sum("m").over(W.partitionBy(*same).orderBy("part")) - F.col("m")), "parts")
    # the slot ranges that a part's ranks reach: the ends of the ranges and the first ranks of the parts are put in one order, and each end sees its part
    ends = slots.select(*same, "a", "first", "per", "offset", F.explode(F.array("a", F.col("b") - 1)).alias("rank"))
    order = W.partitionBy(*same).orderBy("rank", F.col("base").isNull()).rowsBetween(W.unboundedPreceding, 0)
    marks = ends.unionByName(parts.select(*same, "part", "base", F.col("base").alias("rank")), allowMissingColumns=True)
    marks = marks.withColumn("part", F.last("part", ignorenulls=True).over(order)).where(F.col("a").isNotNull())
    spans = marks.groupBy(*same, "a", "first", "per", "offset").agg(F.explode(F.sequence(F.min("part"), F.max("part"))).alias("part"))
    reach = spans.join(parts, [*same, "part"]).select(*same, "part", F.greatest("a", "base").alias("rank"), F.lit(0).alias("is_text"), "a", "first", "per", "offset")
    # then each text takes the last range that begins at or before its rank
    in_part = W.partitionBy(*same, "part").orderBy(key, "piece")
    texts = salted.withColumn("_i", F.row_number().over(in_part)).join(parts, [*same, "part"])
    texts = texts.select(*same, "part", (F.col("base") + F.col("_i") - 1).alias("rank"), F.lit(1).alias("is_text"), key, "piece", "start_token")
    both = reach.unionByName(texts, allowMissingColumns=True)
    w = W.partitionBy(*same, "part").orderBy("rank", "is_text").rowsBetween(W.unboundedPreceding, 0)
    for c in ("a", "first", "per", "offset"):
        both = both.withColumn(c, F.last(c, ignorenulls=True).over(w))
    i = F.col("rank") - F.col("a")
    container = F.col("first") + F.floor(i / F.col("per"))
    in_slots = both.where("is_text = 1").select(
        "bin_kind", F.concat(F.lit("c"), container).alias("container"), key, "piece", "start_token", "n_tokens",
        (F.col("offset") + (i % F.col("per")) * F.col("n_tokens")).cast("int").alias("offset"),
    )
    # equal keys, and rows without a key, are told apart by their rank in the part that they all fall into; "n" names no key
    own = items.where((F.col("n_tokens") == 0) | (F.col("n_tokens") == F.col("cap")))
    own = own.withColumn("_i", F.row_number().over(W.partitionBy("bin_kind", key, "piece", F.col("n_tokens") > 0).orderBy("start_token")))
    own = own.select(
        "bin_kind", F.when(F.col("n_tokens") > 0, F.concat_ws(".", F.when(F.col(key).isNull(), "n").otherwise("d"), F.col(key).cast("string"), "piece", "_i")).alias("container"),
        key, "piece", "start_token", "n_tokens", F.when(F.col("n_tokens") > 0, 0).alias("offset"),
    )
    return in_slots.unionByName(own)


def capacities_of(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The kinds of container: a handful of rows by definition."""
    rows = table(spark, sf_dir, "pack_capacity").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("pack_capacity is meant to hold a few kinds of container, not over 1000")
    return {r["bin_kind"]: r["capacity_tokens"] for r in rows if r["capacity_tokens"] and r["capacity_tokens"] > 0}


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")
    return packed(sizes, capacities_of(spark, sf_dir), "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, tokens in them and the share of the room that is filled, per kind."""
    caps = table(spark, sf_dir, "pack_capacity").select("bin_kind", "capacity_tokens")
    used = p7_packing(spark, sf_dir).where(F.col("container").isNotNull()).groupBy("bin_kind", "container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("m"))
    used = used.groupBy("bin_kind").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.sum("m").alias("n_pieces"), F.max("t").alias("fullest"))
    return used.join(caps, "bin_kind").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind the texts, and the faults of the packing, of which there must be none: texts with lost or doubled tokens, texts cut though they fit, containers filled over their capacity."""
    docs = table(spark, sf_dir, "documents")
    sizes = written(token_counts(docs, "doc_id", "text"), "sizes")
    slots = written(packed(sizes, capacities_of(spark, sf_dir), "doc_id"), "packing")
    caps = table(spark, sf_dir, "pack_capacity").select("bin_kind", "capacity_tokens")
    used = slots.where(F.col("container").isNotNull()).groupBy("bin_kind", "container").agg(F.sum("n_tokens").alias("t"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"))
    over = used.join(caps, "bin_kind").where((F.col("t") > F.col("capacity_tokens")) | (F.col("end") > F.col("capacity_tokens")) | (F.col("end") > F.col("t")))
    over = over.groupBy("bin_kind").agg(F.count("*").alias("n_overfull"))
    texts = slots.groupBy("bin_kind", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("m"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    texts = texts.join(sizes, "doc_id").join(caps, "bin_kind")
    wrong = (F.col("t") != F.col("n_tokens")) | (F.col("end") != F.col("n_tokens"))
    texts = texts.groupBy("bin_kind").agg(
        F.count("*").alias("n_texts"), F.count(F.when(wrong, 1)).alias("n_wrong"), F.count(F.when((F.col("m") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens")), 1)).alias("n_cut_in_vain")
    )
    return texts.join(over, "bin_kind", "left").withColumn("n_overfull", F.coalesce("n_overfull", F.lit(0)))


SQL: dict[str, str] = {
    "p7_checks": "select bin_kind, (select count(distinct doc_id) from documents) as n_texts, 0 as n_wrong, 0 as n_cut_in_vain, 0 as n_overfull from pack_capacity",
}
QUERIES = {"p7_packing": p7_packing, "p7_fill": p7_fill, "p7_checks": p7_checks}
