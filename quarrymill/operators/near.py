"""Sets of shingles that contain each other, found block against block.

Texts are kept once, as packed words in files of the shared folder, and shingles, eight bytes each, are worked out
from them wherever they are needed; neither shingles nor candidate pairs are shuffled or written.  A set of n shingles
that shares all but k with another is cut into k + 1 groups of four, and one of the groups must lie in the other set
whole.  A group is sought by its rarest shingle (the lead), and the others (witnesses) are looked up in a filter of
the set that was found, so nearly all false candidates end where they are met.  What is left is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..session import shared_folder

#: Hashed counters by which shingles are ordered: 2^22 of one byte go to every task.
COUNTER_BITS = 22
#: Lists of a block's index; two shingles in one list only add candidates.
LIST_BITS = 24
WITNESSES = 3
#: Most documents (their numbers have 16 bits) and words of a block, and of the parts that it is made of.
BLOCK_DOCUMENTS, BLOCK_WORDS = 1 << 16, 5_000_000
PART_DOCUMENTS, PART_BYTES = 10_000, 1 << 24
#: Places of the index, or shingles of pairs, looked at in one step.
STEP = 1 << 20


def contained_pairs(docs: DataFrame, key: str, words: Column, threshold: float, least: int) -> DataFrame:
    """``a, b, shared, n``: pairs of different texts, ``words`` being their words set apart by single spaces.

    ``n`` is the size of the smaller set.  The work is done when this returns; its files are gone then.
    """
    import uuid

    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/near-{uuid.uuid4().hex}"
    keyed = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), words.alias("t"))
    kind = keyed.schema["id"].dataType.simpleString()
    keyed = keyed.select("id", "t", F.xxhash64("t").alias("h1"), F.hash("t").alias("h2"))
    try:
        parts = sorted(tuple(r) for r in keyed.mapInArrow(_pack(folder), "name string, documents int, words long").collect())
        _mark_first(spark, folder, [p[0] for p in parts], kind)
        blocks = _blocks(parts, spark.sparkContext.defaultParallelism)
        rarity = spark.sparkContext.broadcast(_rarity(_each(spark, len(blocks)).mapInArrow(_count(folder, blocks, least), "block int, counters binary")))
        _each(spark, len(blocks)).mapInArrow(_lead(folder, blocks, least, threshold, rarity), "rows long").collect()
        shares = max(1, -(-spark.sparkContext.defaultParallelism // max(1, len(blocks))))
        found = _each(spark, len(blocks) * shares).mapInArrow(_meet(folder, blocks, shares, least, threshold, rarity), "pairs binary").checkpoint(True)
        rarity.unpersist()
    finally:
        system, path = _system(folder)
        from pyarrow import fs

        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)
    return found.mapInArrow(_unpacked, f"a {kind}, b {kind}, shared int, n int")


def _each(spark, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, n))


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _dumped(*tables: dict) -> bytes:
    import io

    import pyarrow as pa

    out = io.BytesIO()
    for table in map(pa.table, tables):
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
    return out.getvalue()


def _write(path: str, data: bytes) -> None:
    system, path = _system(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(data)


def _read(path: str, tables: int) -> list:
    import pyarrow as pa

    system, path = _system(path)
    with system.open_input_stream(path) as f:
        source = pa.BufferReader(f.read())
    return [pa.ipc.open_stream(source).read_all() for _ in range(tables)]


def _pack(folder: str):
    """Each part of a batch to a file: ids and hashes of the texts, their words as codes, and the words' hashes."""

    def run(batches):
        import hashlib
        import uuid

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                before = size[start - 1] if start else 0
                end = int(min(max(start + 1, np.searchsorted(size, before + PART_BYTES, "right")), start + PART_DOCUMENTS))
                b = batch.slice(start, end - start)
                start = end
                words = pc.split_pattern(b.column("t"), " ")
                b, words = (x.filter(pc.greater_equal(pc.list_value_length(words), V.SHINGLE_WORDS)) for x in (b, words))
                if not b.num_rows:
                    continue
                coded = words.flatten().dictionary_encode()
                hashes = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)
                codes = coded.indices.to_numpy()
                name = uuid.uuid4().hex
                documents = {"id": b.column("id"), "n": words.value_lengths(), "h1": b.column("h1"), "h2": b.column("h2")}
                _write(f"{folder}/{name}", _dumped(documents, {"code": codes.astype(np.uint16) if len(hashes) <= 1 << 16 else codes}, {"hash": hashes}))
                yield pa.RecordBatch.from_pydict({"name": [name], "documents": pa.array([b.num_rows], pa.int32()), "words": [len(codes)]})

    return run


def _mark_first(spark, folder: str, names: list[str], kind: str) -> None:
    """Beside each part a file of the places of its texts that are no copy, which is the smallest id of equal ones."""

    def hashes(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in b.column("id").to_pylist():
                documents = _read(f"{folder}/{names[k]}", 1)[0].combine_chunks()
                for r in documents.to_batches(10_000):
                    yield pa.RecordBatch.from_arrays([r.column("h1"), r.column("h2"), r.column("n"), r.column("id"), pa.array(np.full(len(r), k, np.int32)), pa.array(np.arange(len(r), dtype=np.int32))], ["h1", "h2", "n", "id", "part", "at"])

    def write(rows):
        import numpy as np

        _write(f"{folder}/{names[int(rows['part'].iloc[0])]}-first", _dumped({"at": np.sort(rows["at"].to_numpy())}))
        return rows[["part"]].iloc[:1]

    rows = _each(spark, len(names)).mapInArrow(hashes, f"h1 long, h2 int, n int, id {kind}, part int, at int")
    first = rows.groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "part", "at")).alias("x")).select("x.part", "x.at")
    first.groupBy("part").applyInPandas(write, "part int").collect()


def _blocks(parts: list[tuple[str, int, int]], tasks: int) -> list[list[str]]:
    """Parts put together up to what a task holds, or so that every core has a block."""
    most = min(BLOCK_WORDS, sum(w for _, _, w in parts) // max(1, tasks) + 1)
    blocks: list[list[str]] = []
    documents = words = 0
    for name, d, w in parts:
        if not blocks or documents + d > BLOCK_DOCUMENTS or words + w > max(most, w):
            blocks.append([])
            documents = words = 0
        blocks[-1].append(name)
        documents, words = documents + d, words + w
    return blocks


def _sets(folder: str, block: list[str], least: int, only=None):
    """``ids, places, at, grams, doc``: the distinct shingles of each text that has ``least`` of them, in order.

    Texts are counted through the block without its copies: ``places`` names those that are here, ``only`` those to take.
    """
    import numpy as np
    import pyarrow as pa

    from pyarrow import fs

    ids, sizes, all_words, places, seen = [], [], [], [], 0
    for name in block:
        system, path = _system(f"{folder}/{name}-first")
        if system.get_file_info(path).type == fs.FileType.NotFound:
            continue  # copies only
        first = _read(f"{folder}/{name}-first", 1)[0]["at"].to_numpy()
        here = np.arange(seen, seen + len(first))
        seen += len(first)
        if only is not None:
            taken = np.isin(here, only)
            first, here = first[taken], here[taken]
            if not len(first):
                continue
        documents, codes, hashes = _read(f"{folder}/{name}", 3)
        n = documents["n"].to_numpy().astype(np.int64)
        start, size = (np.cumsum(n) - n)[first], n[first]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        all_words.append(hashes["hash"].to_numpy()[codes["code"].to_numpy()[at]])
        sizes.append(size)
        places.append(here)
        ids.append(documents["id"].combine_chunks().take(pa.array(first)))
    if not ids:
        return None
    word, size, places = np.concatenate(all_words), np.concatenate(sizes), np.concatenate(places)
    doc = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    runs = len(word) - V.SHINGLE_WORDS + 1
    grams = np.zeros(runs, np.uint64)
    for k in range(V.SHINGLE_WORDS):
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[k : k + runs]
    grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    whole = doc[:runs] == doc[len(doc) - runs :]
    grams, doc = grams[whole], doc[:runs][whole]
    order = np.argsort((doc << np.uint64(48)) | (grams >> np.uint64(16)))
    grams, doc = grams[order], doc[order].astype(np.int64)
    close = np.flatnonzero((grams[1:] >> np.uint64(16) == grams[:-1] >> np.uint64(16)) & (grams[1:] < grams[:-1]) & (doc[1:] == doc[:-1]))
    if len(close):  # two that differ in their last 16 bits
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
    kept = np.ones(len(grams), bool)
    kept[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[kept], doc[kept]
    n = np.bincount(doc, minlength=len(size))
    enough = n >= least
    grams, n = grams[enough[doc]], n[enough]
    if not len(n):
        return None
    return pa.concat_arrays(ids).filter(pa.array(enough)), places[enough], np.concatenate([[0], np.cumsum(n)]), grams, np.repeat(np.arange(len(n)), n)


def _slots(grams):
    """The counter of each shingle: the first bits of its hash."""
    import numpy as np

    return (grams >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _count(folder: str, blocks: list[list[str]], least: int):
    """How often a block's shingles fall on each counter, packed, in pieces."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        piece = 1 << 16
        for b in batches:
            for j in b.column("id").to_pylist():
                if (own := _sets(folder, blocks[j], least)) is None:
                    continue
                total = np.bincount(_slots(own[3]), minlength=1 << COUNTER_BITS).astype(np.int32)
                for k in range(len(total) // piece):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "counters": [zlib.compress(total[k * piece : (k + 1) * piece].tobytes(), 1)]})

    return run


def _rarity(counted: DataFrame):
    """The levels of the sums of what ``_count`` gives."""
    import zlib

    import numpy as np
    import pandas as pd

    piece = 1 << 16

    def add(rows):
        total = np.zeros(piece, np.int64)
        for c in rows["counters"]:
            total += np.frombuffer(zlib.decompress(c), np.int32)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "counters": [zlib.compress(_levels(total).tobytes(), 1)]})

    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    for r in counted.groupBy("block").applyInPandas(add, "block int, counters binary").collect():
        out[r["block"] * piece : (r["block"] + 1) * piece] = np.frombuffer(zlib.decompress(r["counters"]), np.uint8)
    return out


def _levels(counts):
    """Counts in one byte: themselves up to 16, then sixteen steps a doubling."""
    import numpy as np

    return np.where(counts <= 16, counts, np.minimum(255, 16 * np.log2(np.maximum(counts, 16)) - 48)).astype(np.uint8)


def _missing(n, threshold: float):
    """How many of a set's n shingles may be missing from a set that contains it."""
    import numpy as np

    return n - np.ceil(n * threshold - 1e-9).astype(np.int64)


def _lead(folder: str, blocks: list[list[str]], least: int, threshold: float, rarity):
    """For each block a file of its groups: list, document, and 16 bits of each witness, ordered by list."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for j in b.column("id").to_pylist():
                if (own := _sets(folder, blocks[j], least)) is None:
                    continue
                ids, places, at, grams, doc = own
                n = np.diff(at)
                level = rarity.value[_slots(grams)]
                order = np.argsort((doc.astype(np.uint64) << np.uint64(48)) | (level.astype(np.uint64) << np.uint64(40)) | (grams >> np.uint64(24)))
                grams = grams[order]
                # A shingle of no other set ends its group, whatever else is in it.
                alone = np.bincount(doc, weights=level <= 1, minlength=len(n)).astype(np.int64)
                groups = np.maximum(0, _missing(n, threshold) + 1 - alone)
                of = np.repeat(np.arange(len(n)), groups)
                lead = (at[:-1] + alone)[of] + np.arange(len(of)) - np.repeat(np.cumsum(groups) - groups, groups)
                lists = (grams[lead] >> np.uint64(64 - LIST_BITS)).astype(np.uint32)
                order = np.argsort((lists.astype(np.uint64) << np.uint64(16)) | of.astype(np.uint64))
                lead, lists, of = lead[order], lists[order], of[order]
                table = {"step": np.diff(lists, prepend=np.uint32(0)), "doc": of.astype(np.uint16)}
                for k in range(1, WITNESSES + 1):
                    w = lead + k * groups[of]
                    table[f"w{k}"] = _witness(grams[np.where(w < at[1:][of], w, lead)])
                whole = alone + (WITNESSES + 1) * groups <= n
                _write(f"{folder}/groups-{j}", _dumped({"n": n.astype(np.int32), "place": places.astype(np.int32), "id": ids, "groups": groups.astype(np.int32), "whole": whole}, table))
                yield pa.RecordBatch.from_pydict({"rows": [len(of)]})

    return run


def _witness(grams):
    import numpy as np

    return ((grams >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16)


def _meet(folder: str, blocks: list[list[str]], shares: int, least: int, threshold: float, rarity):
    """The pairs of a block's sets, as the larger, with the sets of a share of all blocks; a packed value for each two blocks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from pyarrow import fs

        for batch in batches:
            for task in batch.column("id").to_pylist():
                j, share = divmod(task, shares)
                if (own := _sets(folder, blocks[j], least)) is None:
                    continue
                index = _Index(*own, rarity.value)
                for i in range(share, len(blocks), shares):
                    system, path = _system(f"{folder}/groups-{i}")
                    if system.get_file_info(path).type == fs.FileType.NotFound:
                        continue
                    small, table = _read(f"{folder}/groups-{i}", 2)
                    n = small["n"].to_numpy().astype(np.int64)
                    a, b = index.candidates(n, table)
                    a, b = index.likely(a, b, small["groups"].to_numpy(), small["whole"].to_numpy(), table)
                    if not len(a):
                        continue
                    left, right = small["id"].combine_chunks().take(pa.array(a)), index.ids.take(pa.array(b))
                    # Of two sets of one size the smaller id counts as the smaller set.
                    ok = np.where(n[a] < index.n[b], pc.not_equal(left, right).to_numpy(zero_copy_only=False), pc.less(left, right).to_numpy(zero_copy_only=False))
                    a, b = a[ok], b[ok]
                    if not len(a):
                        continue
                    used, a_at = np.unique(a, return_inverse=True)
                    sets = _sets(folder, blocks[i], least, small["place"].to_numpy()[used])
                    shared = index.shared(sets[2], sets[3], a_at, b, _missing(n[used], threshold))
                    ok = shared >= n[a] * threshold - 1e-9
                    if ok.any():
                        left, right = small["id"].combine_chunks().take(pa.array(a[ok])), index.ids.take(pa.array(b[ok]))
                        first = pc.less(left, right)
                        pairs = {"a": pc.if_else(first, left, right), "b": pc.if_else(first, right, left), "shared": shared[ok].astype(np.int32), "n": n[a[ok]].astype(np.int32)}
                        yield pa.RecordBatch.from_pydict({"pairs": pa.array([_dumped(pairs)], pa.binary())})

    return run


class _Index:
    """A block's sets: lists of documents by shingle, smallest sets first, and a filter of each set's shingles."""

    def __init__(self, ids, places, at, grams, doc, rarity):
        import numpy as np
        import pyarrow as pa

        n = np.diff(at)
        order = np.argsort(n, kind="stable")
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n))
        self.ids, self.n, self.start, self.grams = ids.take(pa.array(order)), n[order], at[:-1][order], grams
        met = rarity[_slots(grams)] > 1
        self.keys = np.sort(((grams[met] >> np.uint64(64 - LIST_BITS)) << np.uint64(16)) | rank[doc[met]].astype(np.uint64))
        self.docs = (self.keys & np.uint64(0xFFFF)).astype(np.uint16)
        self.lists = np.zeros((1 << LIST_BITS) + 1, np.int32)
        np.cumsum(np.bincount((self.keys >> np.uint64(16)).astype(np.int64), minlength=1 << LIST_BITS), out=self.lists[1:])
        # Between eight and sixteen places a shingle.
        size = np.minimum(1 << 16, 1 << (np.ceil(np.log2(self.n)).astype(np.int64) + 3))
        self.mask = (size - 1).astype(np.int32)
        self.offset = (np.cumsum(size) - size).astype(np.int32)
        self.filter = np.zeros(size.sum(), bool)
        r = rank[doc]
        self.filter[self.offset[r] + (_witness(grams).astype(np.int32) & self.mask[r])] = True

    def candidates(self, n, table):
        """Documents of the other block (of ``n`` shingles) and of this one, each pair once."""
        import numpy as np

        of, lists = table["doc"].to_numpy(), np.cumsum(table["step"].to_numpy(), dtype=np.uint32)
        w = [table[f"w{k}"].to_numpy() for k in range(1, WITNESSES + 1)]
        begin, end = self.lists[lists].astype(np.int64), self.lists[lists + np.uint32(1)].astype(np.int64)
        least = np.searchsorted(self.n, n, "left")
        rows = np.flatnonzero((end > begin) & (least[of] < len(self.n)))
        begin, end, least = begin[rows], end[rows], least[of[rows]]
        long = np.flatnonzero(end - begin >= 4)
        begin[long] = np.searchsorted(self.keys, (lists[rows[long]].astype(np.uint64) << np.uint64(16)) | least[long].astype(np.uint64))
        count = np.maximum(end - begin, 0)
        upto = np.cumsum(count)
        found = []
        first = 0
        while first < len(rows):
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + STEP, "right")))
            c, r = count[first:last], rows[first:last]
            places = np.arange(c.sum()) + np.repeat(begin[first:last] - (np.cumsum(c) - c), c)
            b = self.docs[places]
            hit = np.flatnonzero(self.filter[self.offset[b] + (np.repeat(w[0][r], c) & self.mask[b])])
            b, r = b[hit], np.repeat(r, c)[hit]
            for x in w[1:]:
                ok = self.filter[self.offset[b] + (x[r] & self.mask[b])]
                b, r = b[ok], r[ok]
            a = of[r]
            ok = self.n[b] >= n[a]
            found.append(np.unique((a[ok].astype(np.uint32) << np.uint32(16)) | b[ok]))
            first = last
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)
        return (pairs >> np.uint32(16)).astype(np.int64), (pairs & np.uint32(0xFFFF)).astype(np.int64)

    def likely(self, a, b, groups, whole, table):
        """The pairs of which fewer witnesses are absent than there are groups, since one more absent shingle than that would be too many."""
        import numpy as np

        order = np.argsort(table["doc"].to_numpy(), kind="stable")
        w = [table[f"w{k}"].to_numpy()[order] for k in range(1, WITNESSES + 1)]
        groups = groups.astype(np.int64)
        start = np.cumsum(groups) - groups
        out = np.ones(len(a), bool)
        upto = np.cumsum(groups[a])
        first = 0
        while first < len(a):
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + STEP, "right")))
            x = a[first:last]
            pair, rows = _spread(start[x], groups[x])
            to = b[first:last][pair]
            offset, mask = self.offset[to], self.mask[to]
            absent = sum(np.bincount(pair[~self.filter[offset + (v[rows] & mask)]], minlength=last - first) for v in w)
            out[first:last] = ~whole[x] | (absent < groups[x])
            first = last
        return a[out], b[out]

    def shared(self, at, grams, a, b, missing):
        """How many shingles each pair shares; 0 where more than ``missing`` of the smaller set are known to be absent."""
        import numpy as np

        out = np.zeros(len(a), np.int64)
        n = np.diff(at)
        upto = np.cumsum(n[a])
        first = 0
        while first < len(a):
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + STEP, "right")))
            pair, places = _spread(at[a[first:last]], n[a[first:last]])
            g, to = grams[places], b[first:last][pair]
            there = self.filter[self.offset[to] + (_witness(g).astype(np.int32) & self.mask[to])]
            ok = np.bincount(pair[~there], minlength=last - first) <= missing[a[first:last]]
            taken = there & ok[pair]
            pair, g, to = pair[taken], g[taken], to[taken]
            low, high = self.start[to].copy(), self.start[to] + self.n[to]
            end = high.copy()
            for _ in range(int(self.n[to].max(initial=1)).bit_length() + 1):
                middle = (low + high) >> 1
                less = (low < high) & (self.grams[np.minimum(middle, len(self.grams) - 1)] < g)
                low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
            same = (low < end) & (self.grams[np.minimum(low, len(self.grams) - 1)] == g)
            out[first:last] = np.bincount(pair[same], minlength=last - first)
            first = last
        return out


def _spread(start, size):
    """Which range, and the places, of ranges one after the other."""
    import numpy as np

    pair = np.repeat(np.arange(len(size)), size)
    return pair, np.arange(len(pair)) + np.repeat(start - (np.cumsum(size) - size), size)


def _unpacked(batches):
    import pyarrow as pa

    for b in batches:
        for x in b.column("pairs"):
            yield from pa.ipc.open_stream(x.as_py()).read_all().combine_chunks().to_batches(10_000)
