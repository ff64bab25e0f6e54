"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, and
decoding by concatenating vocabulary strings.

Texts are cut into pre-tokens as the tokenizer file states; every pre-token is merged on its own, so
a very long text costs n log n of its longest pre-token. Workers keep a bounded cache of merged
pre-tokens. A null text counts as empty: no ids, an empty decoded text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm.common import text_batches

#: The published byte-level pre-token pattern (fixed value); files that name another way of cutting are refused.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE, CACHED_LENGTH = 200_000, 40


def _byte_chars() -> list[str]:
    """The character that stands for each byte in vocabulary strings: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class ByteBpe:
    def __init__(self, path: str, cache: int = CACHE) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        v = self.vocab
        self.ranks = {(v[a], v[b]): (rank, v[a + b]) for rank, (a, b) in enumerate(pairs)}
        wanted = {"model": model.get("type"), "pre_tokenizer": (spec.get("pre_tokenizer") or {}).get("type"), "decoder": (spec.get("decoder") or {}).get("type")}
        if wanted != {"model": "BPE", "pre_tokenizer": "ByteLevel", "decoder": "ByteLevel"} or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"only plain byte-level BPE files are read, not {wanted}")
        chars = _byte_chars()
        self.first = [v[c] for c in chars]
        back = {c: b for b, c in enumerate(chars)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*v.values(), *self.added.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in v.items():
            if token not in self.added:
                self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.find = regex.compile(PATTERN).findall
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.cache: dict[str, list[int]] = {}
        self.room = cache

    def merge(self, data: bytes) -> list[int]:
        """One pre-token's bytes to ids."""
        ids = [self.first[b] for b in data]
        n = len(ids)
        prev, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            if found := ranks.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:  # stale
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                prev[k] = i
                if found := ranks.get((made, ids[k])):
                    heapq.heappush(heap, (found[0], i, made, ids[k], found[1]))
            if (p := prev[i]) >= 0 and (found := ranks.get((ids[p], made))):
                heapq.heappush(heap, (found[0], p, ids[p], made, found[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        extend, cache = out.extend, self.cache
        parts = self.special.split(text) if self.special else [text]
        for at, part in enumerate(parts):
            if at % 2:
                out.append(self.added[part])
                continue
            for piece in self.find(part):
                ids = cache.get(piece)
                if ids is None:
                    ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                    if len(piece) <= CACHED_LENGTH:
                        if len(cache) >= self.room:
                            cache.clear()
                        cache[piece] = ids
                extend(ids)
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Ids that are not in the vocabulary are skipped, as are negative ones."""
        s, n = self.strings, len(self.strings)
        try:
            if min(ids, default=0) >= 0:
                return b"".join(map(s.__getitem__, ids))
        except IndexError:
            pass
        return b"".join(s[i] for i in ids if 0 <= i < n)

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>)."""
    return _run(docs, path, id_col, text_col, "ids array<int>", lambda t, texts: [pa.array([t.encode(x) for x in texts], pa.list_(pa.int32()))])


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): null ids give an empty text."""
    path = path or default_path()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids, in one pass."""

    def columns(t: ByteBpe, texts):
        n, a, b = [], [], []
        for x in texts:
            ids = t.encode(x)
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(t.decimal.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return _run(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _run(docs, path, id_col, text_col, fields, columns) -> DataFrame:
    text_batches(docs.sparkSession)
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *[f.split()[0] for f in fields.split(", ")]]

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *columns(t, (x.as_py() or "" for x in b.column(1)))], names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, {fields}")
