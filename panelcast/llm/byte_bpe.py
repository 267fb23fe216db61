"""Byte-level BPE by a global shuffle of distinct words.

1. Each task cuts its texts into pre-tokens with positions and numbers the distinct words of
   a block of documents (at most BLOCK pre-tokens, so memory is bounded). A document is then a
   list of word numbers, in order of position.
2. The distinct words of all blocks are shuffled by their hash; where they meet, each
   distinct word is encoded once, however many blocks hold it.
3. The ids are joined back to their block and the documents reassembled by position.
4. Decoding looks the ids up in the token-byte table, whose size is the vocabulary's.

Words and positions travel packed (one row per block and bucket of words), since a row per
pre-token would shuffle several times the size of the texts. Documents and words leave
step 1 through the same exchange, which Spark reuses, so that the texts are cut once.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import received, ship, shuffle_width, table

BLOCK = 1 << 20
#: The longest word that is merged by plain scanning; longer ones use a heap.
SCAN = 96
#: Unicode's White_Space, which `\s` means in the tokenizer's own library.
SPACE = r"\t-\r \x85\xA0  -     　"
PACKED = "_key long, _block long, _payload binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def splitter(pattern: str):
    """The pattern compiled with explicit white space classes."""
    plain = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(plain)


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank, leftmost first, merges until none is known."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SCAN:
        return _encode_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    far = len(ranks) + 1 << 20
    pairs = [ranks.get(parts[i] + parts[i + 1], far) for i in range(len(parts) - 1)]
    while pairs:
        low = min(pairs)
        if low == far:
            break
        i = pairs.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], far)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs over a linked list: n log n in the word's length."""
    n = len(word)
    end = list(range(1, n + 1))  # part i is word[i:end[i]]; 0 once merged away
    left = list(range(-1, n - 1))
    heap = []

    def offer(i):
        j = end[i]
        if j < n and (rank := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue  # one of the two has merged since
        end[i], end[j] = k, 0
        if k < n:
            left[k] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def _pack(*arrays) -> bytes:
    """Unsigned 32-bit arrays, or bytes, by byte planes: the high planes are nearly empty."""
    out = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        body = a if isinstance(a, bytes) else np.ascontiguousarray(
            np.asarray(a, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        out += [np.array([len(body)], "<u4").tobytes(), body]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(payload: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    out, at = [], 4
    for _ in range(int(np.frombuffer(raw, "<u4", 1)[0])):
        size = int(np.frombuffer(raw, "<u4", 1, at)[0])
        out.append(raw[at + 4:at + 4 + size])
        at += 4 + size
    return out


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


class _Numbering(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _cut(pattern: str, buckets: int, block_tokens: int):
    """Rows (key, block, payload): the words of each block by bucket, and its documents."""
    def run(batches):
        find = splitter(pattern).findall
        part, serial = TaskContext.get().partitionId(), 0
        codes, rows, numbering, total = [], [], _Numbering(), 0

        def flush():
            nonlocal codes, rows, numbering, total, serial
            flat = np.concatenate(codes) if codes else np.empty(0, np.int32)
            counts = np.bincount(flat, minlength=len(numbering))
            order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
            renumbered = np.empty(len(order), np.int32)
            renumbered[order] = np.arange(len(order), dtype=np.int32)
            listed = list(numbering)
            words = [listed[i].encode() for i in order]
            print_ = xxhash.xxh3_64_intdigest(b"\0".join(words))
            block = (xxhash.xxh3_64_intdigest(f"{part} {serial} {print_}".encode()) >> 1) | 1
            ids = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows])], ["i"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as w:
                w.write_batch(ids)
            out = [(block, block, _pack(sink.getvalue().to_pybytes(), [r[1] for r in rows], renumbered[flat],
                                        [len(words)]))]
            home = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
            by_home = np.argsort(home, kind="stable")
            edges = np.searchsorted(home[by_home], np.arange(buckets + 1))
            for b in range(buckets):
                mine = by_home[edges[b]:edges[b + 1]]
                if len(mine):
                    some = [words[i] for i in mine]
                    out.append((-1 - b, block, _pack(np.diff(mine, prepend=0), list(map(len, some)), b"".join(some))))
            codes, rows, numbering, total = [], [], _Numbering(), 0
            serial += 1
            for key, block_, payload in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int64()), pa.array([block_], pa.int64()), pa.array([payload], pa.binary())],
                    ["_key", "_block", "_payload"])
        for batch in batches:
            ids = batch.column(0)
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                found = find(text) if text else []
                codes.append(np.fromiter(map(numbering.__getitem__, found), np.int32, len(found)))
                rows.append((ids[k].as_py(), len(found)))
                total += len(found)
                if total >= block_tokens:
                    yield from flush()
        if rows:
            yield from flush()
    return run


def _encode_bucket(shipped):
    """One bucket of words, all blocks: each distinct word is encoded once; ids go to (block).

    The blocks' rows pass by batch after batch; only the bucket's distinct words are held.
    """
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() >= 0:
            for _ in batches:  # a block's documents are no bucket
                pass
            return
        ranks = received(shipped)
        known: dict[bytes, list[int]] = {}
        for rows in batches:
            keys, payloads = [], []
            for block, payload in zip(rows.column("_block").to_pylist(), rows.column("_payload"), strict=True):
                codes, lengths, raw = _unpack(payload.as_py())
                at, ids, sizes = 0, [], []
                for n in _numbers(lengths).tolist():
                    word = raw[at:at + n]
                    at += n
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode_word(word, ranks)
                    ids += got
                    sizes.append(len(got))
                keys.append(block)
                payloads.append(_pack(_numbers(codes), sizes, ids))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())],
                                             ["_key", "_block", "_payload"])
    return run


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table as arrays by id: length, start, and all bytes."""
    tokens = sorted((rank, token) for token, rank in ranks.items())
    lengths = np.zeros(tokens[-1][0] + 1, np.int64)
    lengths[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
    return lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(t for _, t in tokens), np.uint8)


def _look_up(ids: bytes, tokens: tuple) -> bytes:
    lengths, start, raw = tokens
    x = np.frombuffer(ids, "<u4")
    return raw[_spread(start[x], lengths[x])].tobytes()


def _reassemble(shipped, decoded: bool):
    def run(key, docs, words):
        if key[0].as_py() < 0 or not docs.num_rows:
            return _documents(pa.array([], pa.int64()), [], [] if decoded else None)
        token_table = received(shipped) if decoded else None
        (payload,) = docs["_payload"].to_pylist()
        ids, counts, codes, size = _unpack(payload)
        with pa.ipc.open_stream(ids) as reader:
            doc_ids = reader.read_all()["i"].combine_chunks()
        counts, codes, size = _numbers(counts), _numbers(codes), int(_numbers(size)[0])
        length, start, flat, filled = np.zeros(size, np.int64), np.zeros(size, np.int64), [], 0
        for p in words["_payload"]:
            which, sizes, tokens = map(_numbers, _unpack(p.as_py()))
            which = np.cumsum(which)
            length[which] = sizes
            start[which] = filled + np.cumsum(sizes) - sizes
            flat.append(tokens.astype("<u4"))
            filled += len(tokens)
        if (length == 0).any():
            raise RuntimeError("a block's words differ between attempts of its task; write the input first")
        flat = np.concatenate(flat) if flat else np.empty(0, "<u4")
        out, at = [], 0
        for n in counts.tolist():
            c = codes[at:at + n]
            at += n
            out.append(flat[_spread(start[c], length[c])].tobytes())
        return _documents(doc_ids.cast(pa.int64()), out, [_look_up(x, token_table) for x in out] if decoded else None)
    return run


def _documents(doc_ids, ids: list[bytes], texts: list[bytes] | None) -> pa.Table:
    columns = {"_id": doc_ids, "_ids": pa.array(ids, pa.binary())}
    return pa.table(columns | ({} if texts is None else {"_bytes": pa.array(texts, pa.binary())}))


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + length[0] - 1, then the same for the next ..., as one array."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - ends + length, length)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           block_tokens: int = BLOCK, decoded: bool = False) -> DataFrame:
    """One row per input row: <id_col>, ids (binary: little-endian unsigned 32-bit integers).

    With `decoded` also decoded, the bytes that the ids stand for in the token-byte table, as
    `decode` gives them, looked up where the ids are made. A null or empty text has no ids.
    Texts are encoded whole, however long; special tokens are ordinary text. Repeated rows are
    encoded each; an empty table gives an empty result; other columns are ignored. The rank
    file is read on the driver; its path is a parameter.
    """
    spark = docs.sparkSession
    ranks = read_ranks(rank_file)
    tokens = ship(spark, token_bytes(ranks))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    cut = rows.mapInArrow(_cut(pattern, shuffle_width(spark), block_tokens), PACKED)
    encoded = cut.groupBy("_key").applyInArrow(_encode_bucket(ship(spark, ranks)), PACKED)
    out = (cut.groupBy("_key").cogroup(encoded.groupBy("_key"))
           .applyInArrow(_reassemble(tokens, decoded), "_id long, _ids binary" + ", _bytes binary" * decoded))
    return out.select(F.col("_id").alias(id_col), F.col("_ids").alias("ids"),
                      *([F.col("_bytes").alias("decoded")] if decoded else []))


def decode(encoded: DataFrame, rank_file: str, ids_col: str = "ids", to_col: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its ids: the ids meet the token-byte table, one row a token,
    which is broadcast (its size is the vocabulary's). Null ids decode to null."""
    shipped = ship(encoded.sparkSession, token_bytes(read_ranks(rank_file)))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = received(shipped)
        for part in parts:
            yield pa.array([None if x is None else _look_up(x, tokens) for x in (i.as_py() for i in part)], pa.binary())
    column = F.arrow_udf(run, "binary")
    return encoded.withColumn(to_col, column(F.col(ids_col)))


def digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = encode(docs, rank_file, pattern, id_col, text_col, decoded=True)
    return both.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                   public_tokenizers.PATTERN)
