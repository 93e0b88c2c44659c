"""Exact substring dedup over bytes: maximal repeats from common-prefix interval trees.

1. Anchors: in every stretch of 50 bytes the 24-byte gram with the least hash is an anchor. Equal
   stretches choose equal anchors, so all occurrences of a repeated stretch meet at one anchor key.
   The context of an anchor is the 26 bytes before it and the 50 bytes from it on: no stretch of 50
   bytes that chose it reaches further.
2. Anchors travel packed, 15 bytes each: key, fingerprint of the context, and short fingerprints of the
   37 bytes that end and that begin with the anchor, one of which every stretch holds. A task sends one
   anchor for each context of its chunk, and one alone for a key with very many, so no key is hot.
   Where a context is met in an earlier text, all of it is covered.
3. Contexts that share a half with another context are left. They are sorted: a sparse enhanced suffix array.
   A stack scan over its longest common prefixes gives the interval tree. The members of each
   interval are scanned the same way by what stands to the left of the anchor: left parts that differ
   end a repeat. Each node of both trees together is a repeat group with all its occurrences; where
   left and right reach 50 bytes, occurrences in texts after the group's first text are covered.
   Keys with very many contexts, which one task could not hold, are settled by a grouped minimum
   over their stretches of 50 bytes, with the same outcome.
4. Covered stretches are merged per text and cut out. Equal texts are settled before all this.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import stored, stored_by
from farelens.llm.shingles import mixed

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1  # places of a gram within a stretch
LEFT = SPAN - 1  # bytes of a context before its anchor
HALF = GRAM + LEFT // 2  # a stretch that chose the anchor has so many bytes up to the gram's end, or from it on
PIECE = 256
CHUNK = 2_000_000  # anchors that a task settles by itself before it sends any
BUCKET_BYTES = 32 << 20  # text whose anchors meet in one bucket of keys
STORED_BYTES = 8 << 20  # text stored together
MOST_BUCKETS = 100_000  # that Spark allows by default; beyond, buckets of texts grow
CHUNK_CONTEXTS = 1_000  # of one key in one chunk; beyond, all are scanned and one stands for them elsewhere
MOST_CONTEXTS = 5_000  # of one key in one interval tree; beyond, stretches are grouped instead

OPEN, SURE, MET, SCAN = range(4)  # sent: an anchor, one to be scanned in any case; settled: covered, to be scanned


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over values[i : i + width] for each i."""
    reach, done = values, 1
    while done * 2 <= width:
        reach = best(reach[:-done], reach[done:])
        done *= 2
    return best(reach[: len(reach) - (width - done)], reach[width - done :]) if done < width else reach


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places, 48-bit context fingerprints, two 16-bit fingerprints of halves) of one text's anchors."""
    if len(raw) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint32)
    x = np.frombuffer(bytes(LEFT) + raw + bytes(LENGTH), np.uint8).astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    own = x[LEFT : LEFT + len(raw) - 7]
    grams = mixed(mixed(mixed(own[:-16]) + own[8:-8]) + own[16:])
    least = _sliding(grams, SPAN, np.minimum)  # one for each stretch
    around = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
    places = np.flatnonzero(grams == _sliding(around, SPAN, np.maximum))
    # Contexts are padded with zero bytes at the ends of a text, so their lengths count as well.
    before, after = np.minimum(places, LEFT), np.minimum(len(raw) - places, LENGTH)
    context = (before * (LENGTH + 1) + after).astype(np.uint64)
    context = _hashed(x, places, LEFT + LENGTH, context)
    ends = _hashed(x, places + LEFT - LEFT // 2, HALF, places.astype(np.uint64) * 0)
    begins = _hashed(x, places + LEFT, HALF, places.astype(np.uint64) * 0)
    halves = (ends >> np.uint64(48) << np.uint64(16)) | (begins >> np.uint64(48))
    return grams[places], places, context >> np.uint64(16), halves.astype(np.uint32)


def _hashed(x: np.ndarray, starts: np.ndarray, length: int, seed: np.ndarray) -> np.ndarray:
    """Fingerprints of ``length`` bytes from each start, x holding 8 bytes at every place."""
    for at in (*range(0, length - 8, 8), length - 8):
        seed = mixed(seed + x[starts + at] + np.uint64(1))
    return seed


def _row(bucket: int, kind: int, ids, keys, contexts, halves):
    packed = contexts.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    gaps = zlib.compress(np.diff(ids, prepend=0).tobytes(), 1)
    return bucket, kind, gaps, keys.tobytes(), packed, halves.tobytes()


SENT = "bucket int, kind int, ids binary, keys binary, contexts binary, halves binary"


def _unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view(np.int64).ravel()


def _groups(ids, keys, contexts):
    """For rows ordered by key, context and id: key number, first row of its context, least id of its context."""
    first_k = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    first_c = first_k | np.concatenate([[True], contexts[1:] != contexts[:-1]])[: len(keys)]
    leader = ids[np.flatnonzero(first_c)[np.cumsum(first_c) - 1]] if len(ids) else ids
    return np.cumsum(first_k) - 1, first_c, leader


def _alone(keys) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, whether the key of each place in that order occurs once)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])
    return order, (new[:-1] & new[1:])[: len(keys)]


def _settle(ids, keys, contexts, halves, buckets: int):
    """Rows of one chunk: what is settled within it, and the anchors that other chunks must see."""
    order, alone = _alone(keys)
    some = order[~alone]
    some = some[np.lexsort((ids[some], contexts[some], keys[some]))]
    i, c = ids[some], contexts[some]
    key_no, first_c, leader = _groups(i, keys[some], c)
    number = np.cumsum(first_c) - np.concatenate([[0], np.cumsum(np.bincount(key_no, first_c))])[key_no] if len(i) else i
    crowded = (np.bincount(key_no, first_c) > CHUNK_CONTEXTS)[key_no] if len(i) else first_c
    for kind, mask in ((MET, i > leader), (SCAN, crowded & (i == leader))):
        at = np.flatnonzero(mask)
        for n, start in enumerate(range(0, len(at), 50_000)):
            part = at[start : start + 50_000]
            part = part[np.argsort(i[part], kind="stable")]
            yield _row(n % buckets, kind, i[part], keys[:0].astype(np.uint32), c[part], halves[:0])
    for kind, sent in (
        (OPEN, np.sort(np.concatenate([order[alone], some[first_c & ~crowded]]))),
        (SURE, some[first_c & crowded & (number == 1)]),
    ):
        bucket = (keys[sent] % np.uint64(buckets)).astype(np.int32)
        by_bucket = np.argsort(bucket, kind="stable")
        sent, bucket = sent[by_bucket], bucket[by_bucket]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(sent) else []
        for a, b in zip(edges, [*edges[1:], len(sent)]):
            part = sent[a:b]
            short = (keys[part] >> np.uint64(32)).astype(np.uint32)
            yield _row(int(bucket[a]), kind, ids[part], short, contexts[part], halves[part])


def _send(buckets: int):
    def send(batches):
        names = ["bucket", "kind", "ids", "keys", "contexts", "halves"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        held: list[tuple] = []
        size = 0

        def flush():
            rows = list(_settle(*[np.concatenate(v) for v in zip(*held)], buckets)) if size else []
            columns = zip(*rows) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names)

        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                piece = batch.slice(start, PIECE)
                for node, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    keys, _, contexts, halves = anchors(text.encode())
                    contexts, at = np.unique(contexts, return_index=True)
                    held.append((np.full(len(at), node, np.int64), keys[at], contexts, halves[at]))
                    size += len(at)
                    if size >= CHUNK:
                        yield flush()
                        held, size = [], 0
        yield flush()

    return send


def _shared_half(key_no, half) -> np.ndarray:
    """Whether another row of the same key has the same half."""
    order, alone = _alone(key_no.astype(np.uint64) << np.uint64(16) | half)
    shared = np.empty(len(order), bool)
    shared[order] = ~alone
    return shared


def _wanted_of(bucket: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, contexts, scan) settled by the anchors that met in one bucket."""
    ids, keys, contexts, halves, sure = (np.concatenate(v) for v in zip(*bucket))
    order, alone = _alone(keys)
    some = order[~alone]
    some = some[np.lexsort((ids[some], contexts[some], keys[some]))]
    i, c, s = ids[some], contexts[some], sure[some]
    if not len(i):
        return i, c, s
    key_no, first_c, leader = _groups(i, keys[some], c)
    # Halves are compared between contexts, each seen once; rows of one id and context go together.
    shared = np.zeros(len(i), bool)
    of_context = np.cumsum(first_c) - 1
    h = halves[some][first_c]
    for half in (h >> np.uint32(16), h & np.uint32(0xFFFF)):
        shared |= _shared_half(key_no[first_c], half.astype(np.uint64))[of_context]
    any_sure = (np.bincount(key_no, s) > 0)[key_no]
    scan = (i == leader) & ~s & (shared | any_sure)
    chosen = scan | (i > leader)
    return i[chosen], c[chosen], scan[chosen]


def _meet(batches):
    """Rows come sorted by bucket; a bucket may go on in the next batch."""
    current, held = None, []

    def out(ids, contexts, scan):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(contexts), pa.array(scan)], ["id", "context", "scan"])

    for batch in batches:
        for bucket, kind, gaps, keys, contexts, halves in zip(*[batch.column(n).to_pylist() for n in range(6)]):
            if bucket != current:
                if held:
                    yield out(*_wanted_of(held))
                current, held = bucket, []
            ids = np.cumsum(np.frombuffer(zlib.decompress(gaps), np.int64))
            contexts = _unpacked(contexts)
            if kind in (MET, SCAN):
                yield out(ids, contexts, np.full(len(ids), kind == SCAN))
            else:
                keys, halves = np.frombuffer(keys, np.uint32), np.frombuffer(halves, np.uint32)
                held.append((ids, keys, contexts, halves, np.full(len(ids), kind == SURE)))
    if held:
        yield out(*_wanted_of(held))


PLACED = "id long, start long, end long, key long, before binary, after binary"


def _places(batches):
    """From (id, t, met, scan) the stretches that are covered already and the contexts to be scanned."""
    names = ["id", "start", "end", "key", "before", "after"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE):
            piece = batch.slice(start, PIECE)
            rows = []
            for node, text, met, scan in zip(*[piece.column(i).to_pylist() for i in range(4)]):
                raw = text.encode()
                keys, places, contexts, _ = anchors(raw)
                contexts = contexts.view(np.int64)
                covered = places[np.isin(contexts, np.array(met, np.int64))]
                begin, end = np.maximum(covered - LEFT, 0), np.minimum(covered + LENGTH, len(raw))
                long = end - begin >= LENGTH
                begin, end = begin[long], end[long]
                heads = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(begin) else []
                for a, b in zip(heads, [*heads[1:], len(begin)]):
                    rows.append((node, int(begin[a]), int(end[b - 1]), None, None, None))
                keep = np.isin(contexts, np.array(scan, np.int64))
                for key, place in zip(keys[keep].view(np.int64).tolist(), places[keep].tolist()):
                    before = raw[max(0, place - LEFT) : place][::-1]
                    rows.append((node, place, place, key, before, raw[place : place + LENGTH]))
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names)


def _common(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def intervals(ordered: list[bytes], least: int):
    """(depth, first, last) of the common-prefix intervals of sorted strings, by one stack scan.

    Single strings are intervals of their own length. Depths below ``least`` are left out.
    """
    stack: list[tuple[int, int]] = []  # depth, first
    for i, own in enumerate(ordered):
        shared = _common(ordered[i - 1], own) if i else 0
        first = i
        while stack and stack[-1][0] > shared:
            depth, first = stack.pop()
            if depth >= least:
                yield depth, first, i - 1
        if not stack or stack[-1][0] < shared:
            stack.append((shared, first))
        if len(own) > shared:
            stack.append((len(own), i))
    while stack:
        depth, first = stack.pop()
        if depth >= least:
            yield depth, first, len(ordered) - 1


def _covered(group: list[tuple[bytes, bytes, int, int]]):
    """(id, start, end) covered in the occurrences (after, before, id, place) of one key."""
    group.sort()
    best: dict[tuple[int, int, int], int] = {}
    for right, first, last in intervals([g[0] for g in group], GRAM):
        if first == last:
            continue
        members = sorted(group[first : last + 1], key=lambda g: g[1])
        for left, a, b in intervals([g[1] for g in members], max(0, LENGTH - right)):
            if a == b:
                continue
            earliest = min(m[2] for m in members[a : b + 1])
            for _, _, node, place in members[a : b + 1]:
                if node > earliest:
                    where = (node, place, right)
                    best[where] = max(best.get(where, 0), left)
    for (node, place, right), left in best.items():
        yield node, place - left, place + right


def _scan(batches):
    """Rows come sorted by key; a key may go on in the next batch."""
    current, group = None, []
    for pdf in batches:
        found = []
        for key, node, place, before, after in pdf.itertuples(index=False, name=None):
            if key != current:
                found.extend(_covered(group) if len(group) > 1 else ())
                current, group = key, []
            group.append((bytes(after), bytes(before), node, place))
        yield pd.DataFrame(found, columns=["id", "start", "end"])
    yield pd.DataFrame(list(_covered(group)), columns=["id", "start", "end"])


def _grams(batches):
    """(gram, other, id, place) of each stretch of 50 bytes within the contexts of the batch."""
    for pdf in batches:
        rows = []
        for node, place, before, after in zip(pdf["id"], pdf["start"], pdf["before"], pdf["after"]):
            whole = bytes(before)[::-1] + bytes(after)
            for at in range(len(whole) - LENGTH + 1):
                digest = xxhash.xxh3_128_digest(whole[at : at + LENGTH])
                halves = int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True)
                rows.append((*halves, node, place - len(before) + at))
        yield pd.DataFrame(rows, columns=["gram", "other", "id", "start"])


def covered(texts: DataFrame, total_bytes: int, *, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(id, spans): the covered stretches of each text that has any. texts: (id, t), all different."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * max(partitions, -(-total_bytes // BUCKET_BYTES))
    sent = texts.select("id", "t").mapInArrow(_send(buckets), SENT)
    settled = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "id long, context long, scan boolean")
    wanted = settled.groupBy("id").agg(
        F.collect_set(F.when(~F.col("scan"), F.col("context"))).alias("met"),
        F.collect_set(F.when(F.col("scan"), F.col("context"))).alias("scan"),
    )
    # Stored first, so that Spark knows its size.
    placed = texts.join(stored(wanted), "id").select("id", "t", "met", "scan")
    placed = stored(placed.mapInArrow(_places, PLACED), compression="zstd")
    spans = placed.where("key IS NULL").select("id", "start", "end")
    contexts = placed.where("key IS NOT NULL")

    crowded = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_contexts).select("key")
    crowded = stored(crowded)
    few = contexts.join(crowded, "key", "left_anti").select("key", "id", "start", "before", "after")
    scanned = few.repartition("key").sortWithinPartitions("key").mapInPandas(_scan, "id long, start long, end long")
    many = contexts.join(crowded, "key", "left_semi").select("id", "start", "before", "after")
    grams = many.mapInPandas(_grams, "gram long, other long, id long, start long")
    least = grams.groupBy("gram", "other").agg(F.min("id").alias("least"))
    repeated = grams.join(least, ["gram", "other"]).where(F.col("id") > F.col("least"))
    repeated = repeated.select("id", "start", (F.col("start") + LENGTH).alias("end"))
    spans = spans.union(scanned).union(repeated)
    return spans.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _cut(batches):
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE):
            out: list[list] = [[], [], [], [], []]
            piece = batch.slice(start, PIECE)
            for node, text, copy, spans in zip(*[piece.column(i).to_pylist() for i in range(4)]):
                raw = (text or "").encode()
                if copy and len(raw) >= LENGTH:
                    spans = [{"start": 0, "end": len(raw)}]
                kept, at, runs = [], 0, 0
                for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                    if a > at or not runs:
                        kept.append(raw[at:a])
                        runs += 1
                    at = max(at, b)
                kept = b"".join([*kept, raw[at:]])
                for column, value in zip(out, (node, len(raw), len(raw) - len(kept), runs, kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)


def cut_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A byte goes if a string of 50 bytes around it also starts in a row with a smaller doc_id. NULL counts
    as the empty text; rows without an id lose nothing and take nothing from others; rows that share
    an id are not earlier than one another; other columns are ignored; an empty table gives an empty result.
    ``most_contexts`` bounds what one task sorts at once and never changes the result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    keyed = source.where("id IS NOT NULL").select("id", F.sha2("t", 256).alias("text_key"), F.octet_length("t").alias("size"))
    firsts = keyed.groupBy("text_key").agg(
        F.min("id").alias("leader"), F.max("id").alias("last"), F.max("size").alias("size"), F.sum("size").alias("all")
    )
    firsts = stored(firsts.where("text_key IS NOT NULL"))
    copies = keyed.join(firsts.where("leader != last"), "text_key").where("id != leader")
    # Rows that share an id may have several texts, so an id alone does not tell a copy.
    copies = stored(copies.groupBy(F.col("id").alias("c_id")).agg(F.collect_set("text_key").alias("c_keys")))
    total, every = firsts.agg(F.sum("size"), F.sum("all")).first()
    # Three joins need the texts, which are shuffled once for all of them.
    buckets = min(max(1, -(-(every or 0) // STORED_BYTES)), MOST_BUCKETS)
    texts = stored_by(source.where("id IS NOT NULL"), "id", buckets)
    known = F.coalesce(F.array_contains("c_keys", F.sha2("t", 256)), F.lit(False))
    marked = texts.join(copies, F.col("id") == F.col("c_id"), "left").select("id", "t", known.alias("copy"))
    leaders = marked.where("NOT copy AND octet_length(t) >= 50")
    found = stored(covered(leaders, total or 0, most_contexts=most_contexts))
    joined = marked.join(found.select(F.col("id").alias("s_id"), "spans"), F.col("id") == F.col("s_id"), "left")
    alone = source.where("id IS NULL").select(
        "id", "t", F.lit(False).alias("copy"), F.lit(None).cast(found.schema["spans"].dataType).alias("spans")
    )
    cut = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    made = joined.select("id", "t", "copy", "spans").union(alone).mapInArrow(_cut, cut)
    return made.withColumnRenamed("id", "doc_id")
