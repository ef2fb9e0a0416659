"""Near-duplicate documents: BagMinHash signatures of the multisets of five-word shingles, bands, exact checks, classes.

Weighted Jaccard similarity of two bags is the sum of the smaller counts over the sum of the larger. A signature component
is the first arrival of a Poisson process over (weight, time) that each shingle brings along, seeded by the shingle; a point
counts for a bag if its weight level is below the bag's count. Weights are counts, so unit levels discretise them exactly.
The processes are hierarchical: one for each dyadic block of levels (0,1], (1,2], (2,4], ..., at a rate of its width, so a
large count costs a logarithm. All components share a process: each arrival falls on a random component, and a process ends
when its next arrival is later than every component of its document. Two signatures agree in a component with a probability
of exactly the weighted Jaccard similarity.

Words are runs of non-white bytes with A-Z in lower case. Documents of equal word sequences are copies and share one
representative, the least doc_id. Representatives that share one of BANDS bands of ROWS components are candidates; links of
similarity 0.8 or more are confirmed on the texts. In a bucket, all members are first checked against its least member, which
settles groups of any size in pairs linear in the group. Buckets that then still hold several classes are cut into blocks of
BLOCK members, each pair of blocks is a group of its own, and there members of different classes whose signatures agree in
AGREE components (four deviations below what 0.8 gives) are confirmed; a pair is looked at in its first common band only.
Blocks of a bucket's largest class do not meet each other, so a large class costs rows in proportion to its size and to the
blocks of other members. Classes are connected components of the links.

Defined results: a text without words (null, empty, blank) is alone in its class. A text of one to four words is one shingle.
A null doc_id is not compared and has a null class; ids are integers, others are refused. Rows that share a doc_id are one document.
An empty table gives no rows; ties go to the least id. Columns that bear the name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import with_places
from .shared import materialize, mix, steps, utf8, word_hashes, words

SHINGLE = 5
SIMILARITY = (4, 5)  # 0.8 as a fraction
BANDS, ROWS = 28, 6
#: Ids sent to all executors at once at most, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a block; those of a mixed bucket meet two blocks at a time.
BLOCK = 512
#: Components, of BANDS * ROWS, in which two signatures agree before their texts are compared.
AGREE = 112

_STEP = np.uint64(0x9E3779B97F4A7C15)
_FIVE = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xD1342543DE82EF95, 0xA0761D6478BD642F)]


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle; `doc` is ascending."""
    counts = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= SHINGLE:
        n = len(hashes) - SHINGLE + 1
        total = hashes[:n] * _FIVE[0]
        for k in range(1, SHINGLE):
            total = mix(total + hashes[k : n + k] * _FIVE[k])
        whole = doc[:n] == doc[SHINGLE - 1 :]
        out, rows = total[whole], doc[:n][whole]
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        total = counts[short].astype(np.uint64)
        for k in range(SHINGLE - 1):
            have = counts[short] > k
            total[have] = mix(total[have] * _FIVE[0] + hashes[first[short[have]] + k])
        out, rows = np.concatenate([out, total]), np.concatenate([rows, short])
    return out, rows


def bags(found: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their counts."""
    if not len(found):
        return found, rows, np.zeros(0, np.int64)
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])]))
    return found[first], rows[first], np.diff(np.append(first, len(found)))


def signatures(found: np.ndarray, rows: np.ndarray, counts: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """BagMinHash signatures, n_docs x size; rows without shingles stay infinite."""
    best = np.full(n_docs * size, np.inf)
    seeds, docs, rate, base, top = [], [], [], [], []
    level, block = 0, 0
    while True:  # one process for each dyadic block of levels that a count reaches
        have = counts > level
        if not have.any():
            break
        width = 1 if block == 0 else 1 << (block - 1)
        seeds.append(mix(found[have] + np.array([block], np.uint64) * _STEP))
        docs.append(rows[have])
        rate.append(np.full(have.sum(), float(width)))
        base.append(np.full(have.sum(), level))
        top.append(counts[have])
        level, block = level + width, block + 1
    if not seeds:
        return best.reshape(n_docs, size)
    seed, doc, rate, base, top = (np.concatenate(x) for x in (seeds, docs, rate, base, top))
    at, turn, latest = np.zeros(len(seed)), 0, np.full(n_docs, np.inf)
    while len(seed):
        ahead = int(min(256, max(1, 32768 // len(seed))))
        draw = mix(seed[:, None] + np.arange(turn + 1, turn + ahead + 1, dtype=np.uint64)[None, :] * _STEP)
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        when = np.cumsum(np.concatenate([at[:, None], gap], axis=1), axis=1)[:, 1:]  # one by one, so that `ahead` leaves no trace
        other = mix(draw ^ _FIVE[2])
        part = ((other >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        height = base[:, None] + ((other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate[:, None]).astype(np.int64)
        counts_in = (height < top[:, None]) & (when <= latest[doc][:, None])
        slot = doc[:, None] * size + part.astype(np.int64)
        np.minimum.at(best, slot[counts_in], when[counts_in])
        alive = np.unique(doc)
        latest[alive] = best.reshape(n_docs, size)[alive].max(axis=1)
        at, turn = when[:, -1], turn + ahead
        more = at <= latest[doc]
        seed, doc, rate, base, top, at = seed[more], doc[more], rate[more], base[more], top[more], at[more]
    return best.reshape(n_docs, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, bits.shape[:2]).copy()
    for k in range(rows):
        key = mix(key + bits[:, :, k] * _FIVE[k % 5])
    return key.view(np.int64)


def text_keys(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's word sequence."""
    counts = np.bincount(doc, minlength=n_docs)
    out = np.zeros((2, n_docs), np.uint64)
    if len(hashes):
        first = np.cumsum(counts) - counts
        place = (np.arange(len(hashes)) - first[doc] + 1).astype(np.uint64)
        full = np.flatnonzero(counts)
        for k in (0, 1):
            out[k, full] = mix(np.add.reduceat(mix(hashes ^ (place * _FIVE[k])), first[full]) + counts[full].astype(np.uint64))
    return out[0].view(np.int64), out[1].view(np.int64)


def _sign(batches):
    for whole in batches:
        for batch in steps(whole, "text"):
            raw, offsets = utf8(batch.column("text"))
            starts, ends, doc = words(raw, offsets)
            hashes = word_hashes(raw, starts, ends)
            n = batch.num_rows
            found, rows = shingles(hashes, doc, n)
            signature = signatures(*bags(found, rows), n, BANDS * ROWS)
            keys = band_keys(signature, BANDS, ROWS)
            brief = (mix(signature.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
            t1, t2 = text_keys(hashes, doc, n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.bincount(doc, minlength=n)), pa.array(t1), pa.array(t2), lists, pa.array([x.tobytes() for x in brief], pa.binary())], ["id", "n_words", "t1", "t2", "bands", "brief"])


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = utf8(pa.array([text], pa.string()))
    starts, ends, doc = words(raw, offsets)
    found, _, counts = bags(*shingles(word_hashes(raw, starts, ends), doc, 1))
    return found, counts


def overlap(a: tuple, b: tuple) -> tuple[int, int]:
    """Sums of the smaller and of the larger counts of two bags."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][x], b[1][y]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


def _confirm(batches):
    kept: tuple[int | None, tuple] = (None, ())
    for batch in batches:
        a, b, ta, tb = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
        out = []
        for i in range(batch.num_rows):
            left = a[i].as_py()
            if kept[0] != left:
                kept = (left, _bag(ta[i].as_py()))
            least, most = overlap(kept[1], _bag(tb[i].as_py()))
            if SIMILARITY[1] * least >= SIMILARITY[0] * most > 0:
                out.append(i)
        yield pa.RecordBatch.from_arrays([a.take(pa.array(out, pa.int32())), b.take(pa.array(out, pa.int32()))], ["a", "b"])


def by_ids(df: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on ids (one column of the same name): they are broadcast if few, by a count, and shuffled otherwise."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, how)


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar; docs has id and text."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    texts = materialize(by_ids(docs, "id", ids, "left_semi"), "near-texts")
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """The least id that links lead to: id, root, for all ids of links (a, b). Large-star and small-star steps in turn."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-edges")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.filter("u <> v").distinct(), "near-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id (as `key`), copy_of (the representative of equal texts), class_id (the least id of the class) for every row."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} must be an integer, since classes are named by their least id")
    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = materialize(given.filter(F.col("id").isNotNull()).mapInArrow(_sign, "id long, n_words long, t1 long, t2 long, bands array<long>, brief binary"), "near-signatures")
    worded = signed.filter("n_words > 0")
    # written first: a text that very many documents share is then a large key of a table, which Spark can split in the join
    least = materialize(worded.groupBy("t1", "t2").agg(F.min("id").alias("rep")), "near-least")
    own = F.col("id") == F.col("rep")
    member = materialize(worded.join(least, ["t1", "t2"]).select("id", "rep", F.when(own, F.col("bands")).alias("bands"), F.when(own, F.col("brief")).alias("brief")), "near-members")

    placed = member.filter("bands is not null").select("id", F.posexplode("bands").alias("band", "key"))
    full = placed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last").select("key", "pivot")
    buckets = materialize(placed.join(full, "key"), "near-buckets")
    star = materialize(buckets.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "near-pairs")
    links = materialize(confirm(star, given), "near-links")
    roots = components(links)
    more = materialize(_cross_links(buckets, roots, member, given), "near-links")
    if more.limit(1).count():
        roots = components(links.union(more))
    classes = member.select("id", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("id", "rep", F.coalesce("root", "rep").alias("root"))
    alone = signed.filter("n_words = 0").select("id", F.col("id").alias("rep"), F.col("id").alias("root"))
    no_id = given.filter(F.col("id").isNull()).select("id", F.col("id").alias("rep"), F.col("id").alias("root"))
    return classes.union(alone).union(no_id).select(F.col("id").alias(key), F.col("rep").alias("copy_of"), F.col("root").alias("class_id"))


def _cross_links(buckets: DataFrame, roots: DataFrame, member: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between members of one bucket that are of different classes so far."""
    labelled = buckets.join(roots, "id", "left").select("key", "band", "id", F.coalesce("root", "id").alias("root"))
    mixed = materialize(_mixed(labelled), "near-mixed")
    ids = materialize(mixed.select("id").distinct(), "near-ids")
    texts = materialize(by_ids(docs, "id", ids, "left_semi").join(member.filter("brief is not null").select("id", "brief"), "id"), "near-texts")
    one, main = F.col("n") <= BLOCK, F.col("root") == F.col("main")
    few = F.when(one, 1).otherwise(F.ceil((F.col("n") - F.col("most")) / BLOCK)).cast("int")  # blocks of all other classes come first
    many = F.when(one, 0).otherwise(F.ceil(F.col("most") / BLOCK)).cast("int")
    deal = lambda blocks: F.pmod(F.xxhash64("id", "key"), blocks).cast("int")
    mine = F.when(main & ~one, few + deal(many)).otherwise(deal(few))
    dealt = mixed.withColumn("block", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.when(main, few).otherwise(few + many) - 1)))
    dealt = dealt.select(F.struct("key", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y")).alias("g"), "band", "block", "id", "root").join(texts, "id")
    placed = dealt.select("g.key", "g.x", "g.y", "block", "id", "band", "root", "brief", "text").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "block", "id")
    return placed.mapInArrow(_meet, "a long, b long").distinct()


def _mixed(labelled: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one class, with the buckets' sizes n, largest classes main and their sizes most."""
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("m"))
    kinds = sizes.groupBy("key").agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("root", F.struct("m", "root")).alias("main"))
    return labelled.join(kinds.filter("n > most"), "key")


def _meet(batches):
    """Rows come sorted by group (key, x, y), then block; a group has BLOCK members of each of its blocks, more or less."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out: list[tuple[int, int]] = []
    held: list[tuple] = []
    for row in rows():
        if held and held[-1][:3] != row[:3]:
            out += _met(held)
            held = []
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
                out = []
        held.append(row)
    out += _met(held)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])


def _met(group: list[tuple]) -> list[tuple[int, int]]:
    """Confirmed links of one group, enough to join its classes: a pair of classes already joined here is passed over."""
    if len(group) < 2:
        return []
    _, x, y, _, _, band, *_ = group[0]
    left = [r for r in group if r[3] == x]
    right = left if x == y else [r for r in group if r[3] == y]
    brief = [np.frombuffer(b"".join(r[7] for r in side), np.uint16).reshape(-1, BANDS, ROWS) for side in (left, right)]
    labels = [np.array([r[6] for r in side]) for side in (left, right)]
    wanted = labels[0][:, None] != labels[1][None, :]
    if x == y:
        wanted &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    if not wanted.any():
        return []
    agree, first = np.zeros(wanted.shape, np.int16), np.full(wanted.shape, BANDS, np.int16)
    for k in range(BANDS):
        same = np.zeros(wanted.shape, np.int16)
        for c in range(ROWS):
            same += brief[0][:, None, k, c] == brief[1][None, :, k, c]
        agree += same
        first[(same == ROWS) & (first == BANDS)] = k
    wanted &= agree >= AGREE
    wanted &= first == band
    i, j = np.nonzero(wanted)
    order = np.argsort(-agree[i, j], kind="stable")
    parent: dict[int, int] = {}

    def find(r):
        while parent.get(r, r) != r:
            r = parent[r]
        return r

    bag: dict[int, tuple] = {}
    out = []
    for a, b in zip(i[order], j[order]):
        p, q = left[a], right[b]
        f, g = find(p[6]), find(q[6])
        if f == g:
            continue
        for r in (p, q):
            if r[4] not in bag:
                bag[r[4]] = _bag(r[8])
        least, most = overlap(bag[p[4]], bag[q[4]])
        if SIMILARITY[1] * least >= SIMILARITY[0] * most > 0:
            out.append((min(p[4], q[4]), max(p[4], q[4])))
            parent[max(f, g)] = min(f, g)
    return out


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document of least id of each class stays, once; rows without an id stay, and so do texts without words, null ones
    among them. All columns come out as they went in, whatever their names. Rows that share an id are documents of their own, in order of
    their texts' hashes: equal ones leave one row, different ones stay apart. An empty table stays empty."""
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if again.isEmpty():
        classes = materialize(near_classes(docs.select("doc_id", "text")), "near-classes")
        return by_ids(docs, "doc_id", classes.filter("class_id <> doc_id").select("doc_id").distinct(), "left_anti").select(*docs.columns)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text")
    placed = with_places(rows, [], ["doc_id", F.xxhash64("text")]).withColumn("__place", F.when(F.col("doc_id").isNotNull(), F.col("_place")))
    placed = materialize(placed.select("__row", "__place", "text"), "near-places")
    classes = materialize(near_classes(placed.select("__place", "text"), key="__place"), "near-classes")
    gone = classes.filter("class_id <> __place").select("__place").distinct()
    return by_ids(placed, "__place", gone, "left_anti").select("__row.*")
