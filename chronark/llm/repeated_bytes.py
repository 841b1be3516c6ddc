"""Suffix-array dedup: bytes covered by a string of 100 that also starts earlier in the corpus are removed.

Equal strings of 100 bytes have their 32-byte substring of least hash at the same offset. So the texts are cut into runs of neighbouring windows
with one such minimizer, and only runs whose minimizer occurs twice can hold a repeated window. Those runs, each with the
bytes of all its windows, go to groups by their minimizer, and a group finds every repeated window among its runs: it sorts
their suffixes, takes the Burrows-Wheeler transform and extends intervals backwards, breadth first. Extending by one byte gives
the boundaries between suffixes whose common prefix has length 0, then 1, 2, ...; the search stops at 100, when what isn't
separated shares 100 bytes.

Nothing gathers a whole key: a batch of documents sends a text of a run once, and minimizers of very many batches are replaced by
the windows themselves, which go to groups by their own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LENGTH, SEED = 100, 32
#: Bytes of text that one batch and one group of runs hold about.
BATCH, GROUP = 4 << 20, 1 << 20
#: Minimizers of more batches than this send their windows one by one.
HOT = 4096
_LAST = 2**63 - 1
_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
ITEMS = "group long, key long, doc_id long, hash long, batch long, start long, size long, bytes binary"
SPANS = "doc_id long, hash long, batch long, lo long, hi long"


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(_M[3])
    x ^= x >> np.uint64(29)
    return x


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (a multiple of 4) from each place on; the last ones also cover what is behind the end."""
    padded = np.zeros(len(data) + size + 8, np.uint8)
    padded[: len(data)] = data
    words = np.lib.stride_tricks.as_strided(padded.view()[: len(data) + size].view(), shape=(len(data) + size - 8, 8), strides=(1, 1))
    words = np.ascontiguousarray(words).view("<u8").ravel()
    out = np.full(len(data), _M[0], np.uint64)
    for k in range(0, size, 8):
        step = min(k, size - 8)
        out = (out ^ words[step : step + len(data)]) * np.uint64(_M[1 + (k // 8) % 2] | 1)
        out ^= out >> np.uint64(31)
    return _mix(out)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on, for the places that have so many."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Texts:
    """The documents of a batch, each id and text once, as one array of bytes."""

    def __init__(self, table: pa.Table):
        self.rows = list(zip(table.column("doc").to_pylist(), table.column("hash").to_pylist(), strict=True))
        self.first: dict[tuple[int, int], int] = {}
        data = []
        for (doc, h), text in zip(self.rows, table.column("bytes"), strict=True):
            if (doc, h) not in self.first:
                self.first[doc, h] = len(data)
                data.append(text.as_py())
        self.keys = list(self.first)
        self.ends = np.cumsum([len(x) for x in data], dtype="int64") if data else np.zeros(0, "int64")
        self.starts = np.r_[0, self.ends[:-1]] if data else self.ends
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first window's place, last window's place, minimizer) of runs of windows with one minimizer; places in ``data``."""
        if len(self.data) < LENGTH:
            none = np.zeros(0, "int64")
            return none, none, none, np.zeros(0, np.uint64)
        hashes = _gram_hashes(self.data, SEED)[: len(self.data) - SEED + 1]
        # the hash's high bits and the place: of equal ones the leftmost is taken, so equal windows have their minimizer at the same offset
        low = np.uint64(len(hashes).bit_length())
        least = _sliding_least(hashes >> low << low | np.arange(len(hashes), dtype=np.uint64), LENGTH - SEED + 1)
        whole = np.zeros(len(least) + 1, bool)
        edge = np.zeros(len(least) + 1, bool)
        for a, b in zip(self.starts, self.ends, strict=True):
            if b - a >= LENGTH:
                whole[a : b - LENGTH + 1] = True
                edge[a] = True
        edge[1:-1] |= least[1:] != least[:-1]
        edge[1:] |= whole[1:] != whole[:-1]
        edge[0] = True
        begin = np.flatnonzero(edge[:-1])
        last = np.r_[begin[1:], len(least)] - 1
        begin, last = begin[whole[begin]], last[whole[begin]]
        return np.searchsorted(self.ends, begin, side="right"), begin, last, hashes[least[begin] & ((np.uint64(1) << low) - np.uint64(1))]


def _keys(table: pa.Table) -> pa.Table:
    """The batch's minimizers, each once, with whether it comes back within the batch."""
    keys, n = np.unique(Texts(table).runs()[3], return_counts=True)
    batch = table.column("batch")[0].as_py()
    return pa.table({"key": pa.array(keys.view("int64")), "again": pa.array(n > 1), "batch": pa.array(np.full(len(keys), batch, "int64"))})


def _items(groups: int):
    def run(_: tuple, table: pa.Table, wanted: pa.Table) -> pa.Table:
        """Runs whose minimizer is wanted: each text of a run once, at its first place; a further place is only a span."""
        out: dict[str, list] = {c.split()[0]: [] for c in ITEMS.split(", ")}
        if table.num_rows and wanted.num_rows:
            texts = Texts(table)
            doc, begin, last, key = texts.runs()
            keys = wanted.column("key").to_numpy().view("uint64")
            order = np.argsort(keys)
            at = np.minimum(np.searchsorted(keys[order], key), len(keys) - 1)
            found = keys[order][at] == key
            hot = np.asarray(wanted.column("hot").to_numpy(zero_copy_only=False), bool)[order][at]
            doc, begin, last, key, hot = (x[found] for x in (doc, begin, last, key, hot))
            if hot.any():
                each = np.repeat(np.arange(len(begin)), np.where(hot, last - begin + 1, 1))
                offset = np.arange(len(each)) - np.searchsorted(each, each)
                single = hot[each]
                begin, last = begin[each] + offset, np.where(single, begin[each] + offset, last[each])
                key = np.where(single, _gram_hashes(texts.data, LENGTH)[begin], key[each])
                doc = doc[each]
            # by the order of documents, so that what is kept of equal texts is the earliest
            rank = np.argsort(np.array(sorted(range(len(texts.keys)), key=texts.keys.__getitem__), "int64"))
            raw, seen, batch = texts.data.tobytes(), set(), table.column("batch")[0].as_py()
            ends, starts, signed = (last + LENGTH).tolist(), texts.starts.tolist(), key.view("int64").tolist()
            begin, doc, rows = begin.tolist(), doc.tolist(), []
            for k in np.lexsort((begin, rank[doc])).tolist():
                a, b, (doc_id, h) = begin[k], ends[k], texts.keys[doc[k]]
                text = raw[a:b]
                a, b = a - starts[doc[k]], b - starts[doc[k]]
                if text not in seen:
                    seen.add(text)
                    rows.append((signed[k] % groups, signed[k], doc_id, h, batch, a, b - a, text))
                elif rows and rows[-1][-1] is None and rows[-1][2:4] == (doc_id, h) and a <= rows[-1][5] + rows[-1][6]:
                    rows[-1] = (*rows[-1][:6], b - rows[-1][5], None)
                else:  # only a span, with nothing to compare: any group passes it on
                    rows.append((h % groups, 0, doc_id, h, batch, a, b - a, None))
            for c, v in zip(out, zip(*rows, strict=True), strict=False):
                out[c] = v
        kinds = [pa.binary() if c == "bytes" else pa.int64() for c in out]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of what stands from there on, by ``depth`` symbols at least; symbols under 512."""
    n, have = len(text), 7
    padded = np.r_[text.astype(np.uint64), np.zeros(8, np.uint64)]
    key = np.zeros(n, np.uint64)
    for k in range(have):
        key = key << np.uint64(9) | padded[k : k + n]
    while True:
        order = np.argsort(key)
        placed = key[order]
        new = np.r_[True, placed[1:] != placed[:-1]]
        if have >= depth or new.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        key = rank << np.uint64(32)
        key[: n - have] |= rank[have:]
        have *= 2


def separated(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``order``: whether the common prefix with the one before is shorter than ``length``.

    Backward search, breadth first: an interval of suffixes that start with w, extended by the symbol c before them, is the
    interval of cw. Its end is a boundary of prefixes of w's length, unless a shorter one set it, in which case it isn't searched on.
    """
    n = len(text)
    before = text[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    to = np.empty(n, "int64")
    to[by_symbol] = np.arange(n)
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    previous, following = np.full(n, -1, "int64"), np.full(n, n, "int64")
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    split = np.zeros(n + 1, bool)
    split[0] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        size = hi - lo
        within = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        low, high = np.repeat(lo, size), np.repeat(hi, size)
        starts, ends = np.sort(to[within[previous[within] < low]]), np.sort(to[within[following[within] >= high]]) + 1
        fresh = ~split[ends]
        lo, hi = starts[fresh], ends[fresh]
        split[hi] = True
        if not len(lo):
            break
    return split[:n]


def repeated(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window) of runs of windows of ``LENGTH`` bytes that occur at a place of lower rank too; ``ranks``: of each text's start."""
    sizes = np.array([len(t) for t in texts], "int64")
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + 1
    joined[ends - 1] = 0
    order = suffix_order(joined, LENGTH)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(joined)) - starts[owner]
    class_of = np.cumsum(separated(joined, order, LENGTH))
    whole = (offset + LENGTH <= sizes[owner])[order]
    places, classes = order[whole], class_of[whole]
    late = np.zeros(len(joined) + 2, bool)
    if len(places):
        rank = ranks[owner[places]] + offset[places]
        first = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
        least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(places)]))
        late[places + 1] = rank > least
    edges = np.flatnonzero(late[1:] != late[:-1])  # no run goes on in the next text: a text's last places begin no window
    begin, last = edges[::2], edges[1::2] - 1
    return owner[begin], offset[begin], offset[last]


def _spans(table: pa.Table) -> pa.Table:
    """The repeated spans of one group's runs."""
    key, doc_id, h, batch, start, size = (table.column(c).to_pylist() for c in ("key", "doc_id", "hash", "batch", "start", "size"))
    texts = table.column("bytes").to_pylist()
    rows, lo, hi = [], [], []
    seen: dict[bytes, int] = {}
    texts_of: dict[int, int] = {}
    for k in sorted(range(len(texts)), key=lambda k: (doc_id[k], h[k], start[k])):
        if texts[k] is None or seen.setdefault(texts[k], k) != k:  # the whole run is at an earlier place too
            rows.append(k), lo.append(start[k]), hi.append(start[k] + size[k])
        else:
            texts_of[key[k]] = texts_of.get(key[k], 0) + 1
    # a minimizer's only text has no window of another
    firsts = [k for k in seen.values() if texts_of[key[k]] > 1]
    if firsts:
        # documents in order, far enough apart that no place of one outranks the next
        docs = {d: i for i, d in enumerate(dict.fromkeys((doc_id[k], h[k]) for k in firsts))}
        ranks = np.array([(docs[doc_id[k], h[k]] << 38) + start[k] for k in firsts], "int64")
        for i, a, b in zip(*(x.tolist() for x in repeated([texts[k] for k in firsts], ranks)), strict=True):
            k = firsts[i]
            rows.append(k), lo.append(start[k] + a), hi.append(start[k] + b + LENGTH)
    pick = lambda values: pa.array([values[k] for k in rows], pa.int64())
    return pa.table({"doc_id": pick(doc_id), "hash": pick(h), "batch": pick(batch), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})


def _removed(_: tuple, table: pa.Table, spans: pa.Table) -> pa.Table:
    """What is left of a batch's documents, and the spans that went."""
    texts = Texts(table)
    change = np.zeros(len(texts.data) + 1, "int64")
    if spans.num_rows:
        at = np.array([texts.starts[texts.first[key]] for key in zip(spans.column("doc_id").to_pylist(), spans.column("hash").to_pylist(), strict=True)])
        np.add.at(change, at + spans.column("lo").to_numpy(), 1)
        np.add.at(change, at + spans.column("hi").to_numpy(), -1)
    gone = np.cumsum(change)[:-1] > 0
    made = []
    for a, b in zip(texts.starts, texts.ends, strict=True):
        mine = gone[a:b]
        edges = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
        made.append((int(b - a), int(mine.sum()), [{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)], texts.data[a:b][~mine].tobytes()))
    rows = [made[texts.first[key]] for key in texts.rows] if table.num_rows else []
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
    columns = [table.column("doc_id").combine_chunks(), *(pa.array([r[k] for r in rows], kinds[k + 1][1]) for k in range(4))]
    return pa.Table.from_arrays([pa.array(columns[0].to_pylist(), pa.int64()), *columns[1:]], names=[k for k, _ in kinds])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for each row: its UTF-8 bytes without those covered by a 100-byte string that also
    starts earlier, in a document of a smaller id or earlier in the same.

    ``spans`` are the maximal removed runs, byte offsets, end exclusive; ``kept`` is binary, as a cut may fall within a character.
    A null text is empty. Null ids come after all others; rows with one id and different texts come in the order of a hash of the
    text; rows that repeat an id and its text are one document and get the same result each. Other columns are ignored;
    an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    batches, groups = max(1, -(-size // BATCH)), max(1, -(-size // GROUP))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("bytes"))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc", "hash"), F.lit(batches))).repartition(min(batches, 20000), "batch")
    keys = rows.groupBy("batch").applyInArrow(_keys, "key long, again boolean, batch long").repartition(min(batches, 20000), "key")
    # a key has a row for each batch at most, so its window is small however often its text occurs
    same = Window.partitionBy("key")
    counted = keys.withColumn("n", F.count(F.lit(1)).over(same)).withColumn("several", F.max("again").over(same)).where("n > 1 OR several")
    wanted = counted.select("batch", "key", (F.col("n") > HOT).alias("hot"))
    items = rows.groupBy("batch").cogroup(wanted.groupBy("batch")).applyInArrow(_items(groups), ITEMS)
    spans = items.groupBy("group").applyInArrow(_spans, SPANS)
    return rows.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(_removed, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
