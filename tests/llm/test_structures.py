"""Manifests, spelling variants and binary records against brute force."""

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelight.llm import merkle, overlap, records, variants
from pagelight.llm.common import Scratch, scratch_path
from pagelight.llm.ordering import numbered, running_start

# --- places -----------------------------------------------------------------------------------------


def test_places(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("g"), ((F.col("id") * 7919) % 5003).alias("k"))
    with Scratch(spark, "t") as run:
        got = numbered(run, rows, "g", ["k"]).collect()
        starts = running_start(run, spark.range(3000).select("id", (F.col("id") % 5).alias("size")), "id", "size").collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append((r["pos"], r["k"], r["n"]))
    assert len(got) == 5000
    for places in by.values():
        places.sort()
        assert [p for p, _, _ in places] == list(range(len(places))) and {n for _, _, n in places} == {len(places)} and [k for _, k, _ in places] == sorted(k for _, k, _ in places)
    want = np.concatenate(([0], np.cumsum(np.arange(3000) % 5)))
    assert {r["id"]: r["start"] for r in starts} == {i: int(want[i]) for i in range(3000)}


# --- manifests --------------------------------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, fields=FIELDS):
    return H(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in fields))


def brute_tree(leaves):
    """(root, siblings of each leaf)."""
    nodes, paths = [(h, [i]) for i, h in enumerate(leaves)], [[] for _ in leaves]
    while len(nodes) > 1:
        up = []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for i, (_, under) in enumerate(run):
                for leaf in under:
                    paths[leaf].append((i, [h for j, (h, _) in enumerate(run) if j != i]))
            up.append((H(*(h for h, _ in run)), [x for _, under in run for x in under]))
        nodes = up
    return nodes[0][0], paths


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subroots, own = [], {}
    for s in order:
        mine = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
        root, paths = brute_tree([brute_leaf(r) for r in mine])
        subroots.append(root)
        own[s] = list(zip(mine, paths))
    root, tops = brute_tree(subroots)
    out = []
    for s, subroot, top in zip(order, subroots, tops):
        for r, path in own[s]:
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                changed["text"] = r["text"].replace("\n", "")
            end = brute_leaf(changed)
            for i, others in path + top:
                end = H(*others[:i], end, *others[i:])
            out.append((r["doc_id"], s, brute_leaf(r), subroot, root, H(*(h for _, others in path + top for h in others)), end, end == root))
    return sorted(out, key=repr)


def proved(docs):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = merkle.checked(merkle.manifest(docs, changed={"text": tampered})).collect()
    hexed = lambda r, *names: [bytes(r[n]).hex() for n in names]
    return rows, sorted(((r["id"], r["source"], *hexed(r, "leaf", "subroot", "root"), r["proof_sha256"], *hexed(r, "folded_root"), r["verified"]) for r in rows), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 4}, {"hot": 4500, "b": 2188, "c": 1, None: 3}])
def test_manifest_equals_brute_force(spark, sizes):
    rng = random.Random(1)
    rows = []
    for s, n in sizes.items():
        rows += [{"doc_id": i, "source": s, "lang": "en", "n_chars": i, "text": f"x\n{i}" if i % 3 else "y"} for i in rng.sample(range(10**6), n)]
    if None in sizes:
        rows += [dict(rows[0]), dict(rows[0]), {"doc_id": None, "source": None, "lang": None, "n_chars": None, "text": None}, {"doc_id": None, "source": "b", "lang": "é", "n_chars": -1, "text": ""}]
        rows += [{"doc_id": 77, "source": "", "lang": "", "n_chars": 0, "text": "long\n" * 200_000}]
    docs = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], SCHEMA)
    for c in ("g", "h", "c", "pos", "n", "w", "top", "a.b"):
        docs = docs.withColumn(c, F.lit(1))
    assert proved(docs)[1] == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert proved(spark.createDataFrame([], SCHEMA))[0] == []


def test_witnesses_grow(spark):
    tree = merkle.OpenTree(5, 2)
    leaves = [bytes([i]) * 32 for i in range(5)]
    for i, leaf in enumerate(leaves):
        tree.append(leaf)
        assert len(tree.witness(0)) == (0 if i < 2 else 64)  # its run is complete with the third leaf
    root = tree.finish()
    assert [len(tree.witness(i)) // 32 for i in range(5)] == [3, 3, 3, 2, 2]
    assert all(merkle.folded(leaf, tree.witness(i), (i, 5)) == root for i, leaf in enumerate(leaves))
    assert merkle.folded(leaves[1], tree.witness(0), (0, 5)) != root


# --- spelling variants --------------------------------------------------------------------------------


def edits(w, alphabet):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
    return out - {w}


def test_index_equals_brute_force():
    rng = random.Random(2)
    words = list({"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(900)} | {"a" * 5, "a" * 6, "a" * 40, "ab" * 4, "b" * 300, "b" * 301})
    found = set()
    for forward in (True, False):
        a, b = variants.near_pairs(words, words, forward)
        pairs = {(words[i], words[j]) for i, j in zip(a.tolist(), b.tolist())}
        assert len(pairs) == len(a)
        found |= pairs
    held = set(words)
    assert found == {(w, x) for w in words for x in edits(w, "abé") & held}
    assert all(len(x) == 0 for x in variants.near_pairs([], ["abcde"], True) + variants.near_pairs(["abcde"], [], False))


def brute_variants(rows):
    n = Counter()
    letters = lambda c: c.isascii() and c.isalpha() or "À" <= c <= "ÿ"
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if letters(c):
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    alphabet = set("".join(words))
    near = {w: edits(w, alphabet) & set(words) for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, words[w], len(near[w]), form[w] or "", words.get(form[w], 0), root(w)) for w in words)


def found_variants(docs):
    return sorted((r["word"], r["n"], r["n_near"], r["form"] or "", r["form_n"] or 0, r["root"]) for r in variants.variants(docs).collect())


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["École", "naïveté", "straße", "ÀÿÀÿÀ", "x×÷yzab", "prefixaaa", "prefixaab", "prefixab"]
    pool = [w for w in base for _ in range(rng.choice((1, 2, 8)))]
    pool += [w for b in base for w in rng.sample(sorted(edits(b.lower(), "aeé")), 2)]
    rows = [(i, " ".join(rng.choice((w, w.upper(), w.title())) for w in rng.choices(pool, k=120)) + "一tail_word1 d'accord") for i in range(120)]
    rows += [(None, "nullid nullid nullid"), (5, None), (6, ""), (7, "repeat repeat"), (7, "repeat repeat"), (8, "verylong" * 500 + " " + "longword " * 50_000), (9, ("q" * 3000 + " ") * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(1)).withColumn("a.b", F.lit(1))
    got, want = found_variants(docs), brute_variants(rows)
    assert got == want and sum(1 for r in got if r[3]) > 20
    assert found_variants(docs.limit(0)) == []


def test_common_keys_are_dealt(spark):
    """A beginning that all words share: shares of 50 words and blocks of 64 give the same pairs."""
    rng = random.Random(4)
    words = sorted({"prefix" + "".join(rng.choice("abc") for _ in range(6)) for _ in range(600)})
    rows = spark.createDataFrame([(w, 3 + i % 5) for i, w in enumerate(words)], "word string, n long")
    with Scratch(spark, "t") as run:
        got = {(r["word"], r["near"]) for r in variants.near_words(run, rows, block_words=64, key_words=50).collect()}
    assert got == {(w, x) for w in words for x in edits(w, "abc") & set(words)}


# --- binary records -----------------------------------------------------------------------------------


def slow_crc32c(data):
    state = 0xFFFFFFFF
    for b in data:
        state ^= b
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksums():
    assert slow_crc32c(b"123456789") == 0xE3069283
    rng = random.Random(5)
    parts = [rng.randbytes(n) for n in (0, 1, 3, 4, 5, 8, 63, 64, 65, 127, 128, 129, 1000, 5000)] + [b"\0" * 200, b"123456789"]
    assert records.crc32c(parts).tolist() == [slow_crc32c(p) for p in parts]
    assert records.masked(np.array([0], np.uint32))[0] == 0xA282EAD8


def test_damage_is_seen():
    data = b"".join(f + b"\n" for f in records.frames([records.body("7", b"\1\2\3\4", 2), records.body(None, b"", 2)]))
    places, bodies = records.cut(data, "f")
    assert [records.unpacked(b)[0] for b in bodies] == ["7", None] and records.unpacked(bodies[0])[1].tolist() == [0x201, 0x403]
    assert records.fetch(io.BytesIO(data), *places[0])[0] == "7"
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, OverflowError, MemoryError)):
            records.cut(bytes(bad), "f")
    with pytest.raises(ValueError):
        records.cut(data[:-3], "f")


def test_pieces_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(7)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = records.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 50)
    for k in range(3000):
        text = "".join(rng.choice(" \n\t'sldrevtm" if rng.random() < 0.5 else chr(rng.randrange(256 if k % 2 else 0x3000))) for _ in range(rng.randint(0, 30)))
        text = text.replace("\ufeff", "") + rng.choice(("", "<|endoftext|>", " <|endoftext|> x"))
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def expected(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in rows]
    return [(i, ids, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in made]


def test_records_round_trip(spark):
    rng = random.Random(6)
    words = ["hello", "World's", "naïve", "中文", "12345", "  ", "\n\n", "\t", "it's", "<|endoftext|>", "\U0001f600", "á", "...", "\x00", "\r\n"]
    rows = [(i, rng.choice(("", " ")).join(rng.choices(words, k=rng.randint(0, 60)))) for i in rng.sample(range(10**9), 300)]
    rows += [(-5, None), (-6, ""), (3, "long text " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "t", "hash", "value", "a.b"):
        docs = docs.withColumn(c, F.lit(1))
    want, at = [], 0
    for i, ids, crc in sorted(expected(rows)):
        want.append((i, at, len(ids), crc))
        at += len(ids)
    assert sorted(map(tuple, records.round_trip(docs).select("id", "start", "n_tokens", "ids_crc32").collect())) == want

    path = scratch_path(spark, "t")
    records.write(docs, path, file_bytes=4000)
    ids = {i: x for i, x, _ in expected(rows)}
    assert {r["id"]: r["ids"] for r in records.read(spark, path).collect()} == ids
    entries = records.index(spark, path).collect()
    assert len({r["file"] for r in entries}) > 20
    assert [r["id"] for r in sorted(entries, key=lambda r: (r["file_no"], r["offset"]))] == sorted(ids)
    for r in rng.sample(entries, 20):
        with open(f"{path.removeprefix('file://')}/records/{r['file']}", "rb") as f:
            name, found = records.fetch(f, r["offset"], r["length"])
        assert (int(name), found.tolist()) == (r["id"], ids[r["id"]])
    orders = [[r["id"] for r in records.shuffled(spark, path, seed).collect()] for seed in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == sorted(orders[2]) == sorted(ids)


def test_records_of_awkward_rows(spark):
    rows = [(None, "null id"), (1, "b"), (1, "b"), (1, "a"), (2, None)]
    got = records.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"] is not None, r["id"] or 0, r["ids_crc32"]) for r in got) == sorted((i is not None, i or 0, c) for i, _, c in expected(rows))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1].tolist()] and [r["id"] for r in ordered] == [None, 1, 1, 1, 2]
    assert records.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- near copies of texts made of the same passages -------------------------------------------------------


def test_few_pairs_of_common_passages(spark, monkeypatch):
    """Texts of 5 of 50 standard lines, none similar: pairs stay far below the texts, where a share of all pairs would be thousands. Near copies among them are linked."""
    rng = random.Random(8)
    lines = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(50)]
    texts = {tuple(sorted(rng.sample(range(50), 5))) for _ in range(2500)}
    rows = [(i, "\n".join(lines[k] for k in t)) for i, t in enumerate(sorted(texts))]
    rows += [(10_000 + i, t + " and") for i, (_, t) in enumerate(rows[:5])]
    made, write = {}, Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name in ("pairs", "proposed"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    found = overlap.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).where("id <> component").collect()
    assert {(r["id"], r["component"]) for r in found} == {(10_000 + i, i) for i in range(5)}
    assert made["pairs"] < 300


def test_pipeline_stages_take_any_rows(spark, sf):
    """Nulls, empty, blank and long texts, repeated rows, clashing and dotted names, through every stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    calm = "the garden was quiet and the rain fell softly on old stones near the river bank today"
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first()["text"]
    rows = [(1, calm), (2, calm + " again"), (2, calm + " again"), (3, None), (4, ""), (5, " \n\t"), (None, calm), (None, None), (6, "other words " * 40_000), (6, "one id two texts that differ in every word"), (7, "password=abcdef123456XYZ and nothing else here at all")]
    rows += [(8, f"some words before it {leak} and some words after it")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, `a.b` string, key int")
    for c in ("id", "kept", "component", "_row", "_t", "c0", "c1", "word", "n"):
        docs = docs.withColumn(c, F.lit(0))
    for table in (docs, docs.limit(0)):
        step, columns = table, docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            step = corpus_pipeline.materialize(stage(spark, step, sf), f"t-{name}")
            assert step.columns == columns and step.where(F.col("`a.b`") != "x").count() == 0
        kept = sorted(((r["doc_id"], r["text"]) for r in step.select("doc_id", "text").collect()), key=repr)
        out = {(r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.STAGES[-1][1](spark, step, sf).collect()}
        assert len(out) == len(kept)
        if table is docs:
            ids = [i for i, _ in kept]
            assert sorted(i for i in ids if i is not None) == [1, 3, 6, 6, 7] and ids.count(None) == 2 and (3, None) in kept
            assert [t for i, t in kept if i == 7] == ["[SECRET] and nothing else here at all"] or "abcdef123456XYZ" not in dict(kept)[7]
        else:
            assert kept == []


def test_parities_never_lose_a_pair():
    rng = np.random.default_rng(9)
    for n in (1, 3, 40, 900):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        for extra in (0, 1, n // 10):
            b = np.unique(np.concatenate((a[extra:], rng.integers(-(2**63), 2**63 - 1, extra))))
            differ = sum(int(x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(overlap._parities(a), overlap._parities(b)))
            assert differ <= len(np.setxor1d(a, b))
