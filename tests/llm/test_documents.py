"""Operators on documents against brute force, on texts that are null, blank, short, repeated, periodic, long or foreign."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpuslab.llm import bwt, editprint, factorisation, html_text, huffman, ngram_ratio, packing, pieces, simhash, substring_dedup, tokens, toxicity
from corpuslab.llm.textbatch import blocks
from corpuslab.llm.textstats import Structure
from corpuslab.llm.xxh import xxh64

random.seed(11)
VOCAB = ["the", "and", "Größe", "niño", "qué", "runa", "42", "x", "!!", "it's", "日本", "🙂", "wasi"]
PASSAGE = " ".join(random.choices(VOCAB, k=60))


def text(n):
    return " ".join(random.choices(VOCAB, k=n))


BASE = text(300)
TEXTS = [
    None, "", "   \n", "one", "two words", BASE, BASE, BASE.replace("runa", "run4", 1), PASSAGE + "\n" + text(80), text(50) + "\n" + PASSAGE + "\n" + text(20), "ab" * 400, "ab" * 300 + "z", text(4000),
    "line a b\nline a b\n\nline a b\nother c d", "😀" * 120, text(120) + PASSAGE, "\t a\x0bb\x0cc  d\r\n", "no break space", text(70), "Idiot " * 3 + text(30),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(7 * k, t, "en", k) for k, t in enumerate(TEXTS)] + [(35, BASE, "en", 99), (None, text(40), None, 98)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, fp int")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_xxh64_equals_the_library():
    data = np.frombuffer(random.randbytes(3000), np.uint8)
    starts = np.random.default_rng(1).integers(0, 2900, 300)
    ends = starts + np.random.default_rng(2).integers(0, 100, 300)
    assert [int(x) for x in xxh64(data, starts, ends, 42)] == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]


def fingerprint(t, k, seed=42):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_components(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    own = {7 * k: fingerprint(t, 3) for k, t in enumerate(TEXTS)}
    assert all(r["fp"] % 2**64 == own[r["doc_id"]] for r in got if r["doc_id"] is not None) and len(got) == len(TEXTS) + 2
    part = {d: d for d in own}
    for _ in own:
        for a in own:
            for b in own:
                if (own[a] ^ own[b]).bit_count() <= 3:
                    part[a] = part[b] = min(part[a], part[b])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == part
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 35").count() == 1 and kept.filter("doc_id = 42").count() == 0


def test_simhash_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres, *(centres ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(60))]))
    df = spark.createDataFrame([(int(f.view(np.int64)), k) for k, f in enumerate(fps)], "fp long, node long")
    found = simhash.connected_components(simhash.links(df, 3))
    got = dict(zip(range(len(fps)), range(len(fps)), strict=True)) | {r["node"]: r["component"] for r in found.collect()}
    part = list(range(len(fps)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for k, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps ^ f) <= 3).tolist():
            a, b = root(k), root(j)
            part[max(a, b)] = min(a, b)
    assert got == {k: root(k) for k in range(len(fps))}


def test_manhattan_never_exceeds_hamming():
    a, b = np.random.default_rng(4).integers(0, 2**63, (2, 2000), dtype=np.uint64)
    e, f = simhash.embedding(a), simhash.embedding(b)
    direct = [sum(abs((int(x) >> 2 * s & 3).bit_count() - (int(y) >> 2 * s & 3).bit_count()) for s in range(32)) for x, y in zip(a, b, strict=True)]
    assert (simhash.manhattan(e, f) == direct).all() and (simhash.manhattan(e, f) <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 2])
def test_substrings_that_stand_earlier_go(docs, empty, hot):
    got = {(r["doc_id"], r["digest"]): r for r in substring_dedup.remove_repeated(docs, length=100, hot=hot).collect()}
    seen = set()
    null_text = docs.filter("doc_id is null").first()["text"]
    for d, t in [(None, null_text), *((7 * k, t) for k, t in enumerate(TEXTS))]:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                mark[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        r = got[d, hashlib.sha256(raw).hexdigest()]
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(raw), sum(mark), hashlib.sha256(kept).hexdigest()), d
        assert r["n_spans"] == len(re.findall(rb"\x01+", bytes(mark)))
    assert substring_dedup.remove_repeated(docs).count() == docs.count() and substring_dedup.remove_repeated(empty).count() == 0
    cut = substring_dedup.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count() and cut.filter("doc_id = 0").first()["text"] is None


def test_windows_by_burrows_wheeler_transform():
    for length in (3, 8, 100):
        for alphabet in (b"ab", bytes(range(256))):
            parts = [bytes(random.choices(alphabet, k=length + random.randint(0, 50))) for _ in range(8)]
            parts += [parts[0][2:] + parts[1], b"a" * (length + 40)]
            rank = np.random.default_rng(length).permutation(len(parts))
            seen: dict[bytes, tuple] = {}
            for k in np.argsort(rank).tolist():
                for o in range(len(parts[k]) - length + 1):
                    seen.setdefault(parts[k][o : o + length], (k, o))
            want = [seen[p[o : o + length]] != (k, o) for k, p in enumerate(parts) for o in range(len(p) - length + 1)]
            assert bwt.first_windows(parts, np.array([len(p) - length + 1 for p in parts]), rank, length).tolist() == want


def test_base_rules(docs, empty):
    ratio = np.zeros(ngram_ratio.BUCKETS, np.float32)
    got = {r["doc_id"]: r for r in ngram_ratio.judge(docs, ratio, 0.0).collect()}
    for k, t in enumerate(TEXTS):
        t, w, r = t or "", words(t), got[7 * k]
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(words(line)) and line in lines
            lines.add(line)
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)), k
        assert r["base_failed"] is failed and r["kept"] is not failed
    assert ngram_ratio.judge(empty, ratio, 0.0).count() == 0


def test_ngram_ratio_tells_trusted_from_raw(spark):
    clean = [(k, text(90)) for k in range(60)]
    junk = [(100 + k, " ".join(f"{w.upper()}#{w}" for w in text(90).split())) for k in range(30)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(k, 0) for k in range(100, 110)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in ngram_ratio.judge(df, ngram_ratio.fit(df, labels), -0.1).collect()}
    assert all(kept[k] for k, _ in clean) and not any(kept[k] for k, _ in junk)


def brute_print(t):
    j, emitted = 0, []
    for c in editprint.classes(np.array([ord(c) for c in t], np.uint32)).tolist() if t else []:
        stay = int(editprint._ADVANCE[(c << 12) | (j & 4095)])
        emitted += [c] * stay
        j += stay
    out = f"{j:x}:"
    for level in range(int(editprint.levels(np.array([j]))[0])):
        bits = 0
        for b, s in enumerate(editprint._sampled(np.array([level]))[0].tolist()):
            if s < j:
                bits |= int(editprint.mix(np.array([(emitted[s] << 48) + s], np.uint64))[0] >> np.uint64(63)) << b
        out += f"{bits:016x}"
    return out


def test_fingerprints_and_next(docs, empty):
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in editprint.compared_with_next(unique).collect()}
    for k, t in enumerate(TEXTS):
        t, after, r = t or "", TEXTS[(k + 1) % len(TEXTS)] or "", got[7 * k]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == brute_print(t) and r["edited_fingerprint"] == brute_print(edited)
        assert r["near_edited"] == pytest.approx(editprint.likeness(editprint.parse(r["fingerprint"]), editprint.parse(r["edited_fingerprint"])))
        assert r["near_next"] == pytest.approx(editprint.likeness(editprint.parse(r["fingerprint"]), editprint.parse(brute_print(after))))
    assert got[7 * 5]["near_next"] == 1.0 and got[7 * 6]["near_next"] > 0.7 and got[7 * 12]["near_next"] < 0.3
    assert editprint.compared_with_next(empty).count() == 0 and editprint.compared_with_next(docs).count() == docs.count()
    assert editprint.compared_with_next(unique.filter("doc_id = 35")).first()["near_next"] == 1.0


def library_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_tokens_equal_the_library():
    ids = library_ids()
    bits = ["'", "'s", "'re", "'ll", "ll", "s", "é", " ", "  ", "\n", "\t", " ", "1", "½", "!", "日本", "🙂", "​", "\x1c", "\x85", "<|endoftext|>", "͸", "ǅ", "_"]
    cases = ["".join(random.choices(bits, k=random.randint(0, 12))) for _ in range(3000)] + [t or "" for t in TEXTS]
    got = []
    for _, _, flat, of in tokens.encoded(pa.array(cases), tokens.default_path(), 0):
        got += [flat[a:b].tolist() for a, b in zip(of[:-1], of[1:], strict=True)]
    assert got == [[*ids(c), 0] for c in cases]


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    ids = library_ids()
    huffman.write_tokens(docs, str(tmp_path / "a"), tokens.default_path())
    got = huffman.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    at, order = 0, []
    for r in got:
        raw = np.frombuffer(bytes(r["ids"]), "<u4")
        assert r["start"] == at and r["n_tokens"] == len(raw) and raw[-1] == 0 and r["ids_crc32"] == zlib.crc32(raw.tobytes())
        if r["doc_id"] is not None:
            assert raw[:-1].tolist() == ids(TEXTS[r["doc_id"] // 7])
        at += len(raw)
        order.append(r["doc_id"])
    assert order[0] is None and order[1:] == sorted(order[1:]) and len(got) == docs.count()
    huffman.write_tokens(empty, str(tmp_path / "b"), tokens.default_path())
    assert huffman.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_huffman_codes_are_limited_and_complete():
    counts = np.zeros(50257, np.int64)
    counts[:60] = [2 ** min(k, 50) for k in range(60)]
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= 16 and sum(2.0 ** -int(n) for n in lengths if n) <= 1
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0] and huffman.code_lengths(np.array([1, 1, 2, 4])).tolist() == [3, 3, 2, 1]


def test_packing_places_every_id_once(docs, empty):
    ids = library_ids()
    got = packing.pack(docs, tokens.default_path(), size=64).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 35:
            by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for d, parts in by_doc.items():
        want, at = [*ids(TEXTS[d // 7]), 0], 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    sizes = []
    for s in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(sizes))) and all(s & (s - 1) == 0 and s <= 64 for s in sizes)
    assert packing.pack(empty, tokens.default_path()).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(packing.hilbert(grid, 3))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_pieces_equal_the_library(docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    bits = ["a", "the", " ", "  ", "    ", "\n", "é", "日", "🙂", "th", "ing", "▁", "aa", "1", "\x00", "<s>", "<0x41>"]
    cases = ["".join(random.choices(bits, k=random.randint(0, 14))) for _ in range(1500)] + [t or "" for t in TEXTS]
    work, got, back = pieces.PieceEncoder(pieces.default_path()), [], []
    for _, _, data, offsets in blocks(pa.array(cases), 2000):
        ids, of = work(data, offsets)
        text_, text_of = work.decode(ids, of)
        got += [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:], strict=True)]
        back += [text_[a:b].tobytes().decode() for a, b in zip(text_of[:-1], text_of[1:], strict=True)]
    assert got == lib.encode(cases) and back == [lib.decode(x) for x in got]
    encoded = pieces.encode(docs, pieces.default_path())
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded, pieces.default_path()).collect() if r["doc_id"] is not None} == {7 * k: t or "" for k, t in enumerate(TEXTS)}
    assert pieces.round_trip(docs, pieces.default_path()).filter("not restored").count() == 0 and pieces.encode(empty, pieces.default_path()).count() == 0


def test_pieces_take_the_best_unigram_path(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as schema

    model = schema.ModelProto()
    model.ParseFromString(open(pieces.default_path(), "rb").read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = -float(np.log(i + 3)) - 0.37 * (i % 7)
    path = str(tmp_path / "u.model")
    open(path, "wb").write(model.SerializeToString())
    lib, work = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceEncoder(path)
    for t in TEXTS:
        for _, _, data, offsets in blocks(pa.array([t], pa.string())):
            ids = work(data, offsets)[0].tolist()
        want = lib.encode(t or "")
        total = lambda x: sum(lib.get_score(i) for i in x)  # noqa: E731  equal paths may differ where scores tie
        assert ids == want or total(ids) == pytest.approx(total(want), rel=1e-6)


def test_segments_are_all_maximal_ones():
    def brute(scores):
        if not scores:
            return []
        best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
        if best[0] <= 0:
            return []
        _, _, a, b = best
        left, right = brute(scores[:a]), brute(scores[b:])
        return left + [(a, b - 1)] + [(x + b, y + b) for x, y in right]

    for _ in range(200):
        n = random.randint(1, 25)
        at = sorted(random.sample(range(n), random.randint(0, n // 2)))
        value = {i: random.choice([1.37, 2.11, 3.73]) + random.random() / 100 for i in at}
        scores = [value.get(i, -0.61) for i in range(n)]
        assert [(a, b) for a, b, _ in toxicity.segments(at, [value[i] for i in at], -0.61)] == brute(scores)


def test_toxicity_learns_words_and_stems(spark):
    bad = ["scum", "vequmo", "vequta"]
    rows = [(k, " ".join(random.sample([*text(60).split(), *(random.choices(bad, k=3) if k % 4 == 0 else [])], k=60 if k % 4 else 63))) for k in range(240)]
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "VEQUXX scum, " + text(20))], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(160)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, labels.doc_id < 1000)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all((got[k] >= 0.7) == (k % 4 == 0) for k in range(160, 240)) and got[902] >= 0.7 and got[900] == got[901] < 0.3
    assert toxicity.without_toxic(df, model).count() == 3 + 240 - 60 - 1
    blank = toxicity.fit(df, labels.filter("toxic = 0"), labels.doc_id < 1000)
    assert toxicity.score(df, blank).filter("score >= 0.7").count() == 0


def test_factorisation_machine(spark, empty):
    rows = [(k, text(60) if k % 3 else "BUY NOW!! " * 25) for k in range(150)]
    df = spark.createDataFrame([*rows, (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(100)], "doc_id long, quality int")
    machine = factorisation.fit(df, labels, labels.doc_id < 100)
    got = {r["doc_id"]: r["score"] for r in factorisation.score(df, machine).collect()}
    assert all((got[k] >= 0.3) == (k % 3 > 0) for k in range(100, 150)) and 0 <= got[500] <= 1
    assert factorisation.score(empty, machine).count() == 0
    # the identity equals the sum over pairs
    for _, _, data, offsets in blocks(pa.array([text(12)])):
        index, value, of, dense = factorisation.inputs(data, offsets)
    z = np.clip((dense[0] - machine.mean) / machine.scale, -5, 5)
    x, v = np.concatenate([value, z]), machine.factors[np.concatenate([index, np.arange(len(z)) + factorisation.WORD_BUCKETS])]
    w = machine.linear[np.concatenate([index, np.arange(len(z)) + factorisation.WORD_BUCKETS])]
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert machine.logits(index, value, of, dense)[0] == pytest.approx(machine.bias + w @ x + pairs)


def test_structure_repeats_match_a_counter():
    for _, _, data, offsets in blocks(pa.array([t or "" for t in TEXTS])):
        s = Structure(data, offsets)
        assert s.n_words.tolist() == [len(words(t)) for t in TEXTS] and s.chars.tolist() == [len(t or "") for t in TEXTS]


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a>Home</a></nav>
<article><h1>T &amp; t</h1><p>One <b>b</b>old<br>two &lt;x&gt;<p>three&nbsp;four<div class="share-box">share</div><div class="promo">buy</div>
<div><p>Template box</p></div><form>mail</form><!-- x --><script>var a = "</p>";</script></article><div id="comments"><p>me too</p></div><footer>&copy;</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.replace("three", f"three{k}")) for k in range(8)]
    rows += [(20, "http://b.example/", PAGE), (21, None, None), (22, "x", ""), (23, "http://c.example", "plain &amp; <b>text"), (24, "http://d.example", "<main>a<p>b</main>c")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "T & t One bold two <x> three3 four" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[20]["text"] == "T & t One bold two <x> three four Template box"
    assert got[21]["text"] == got[22]["text"] == "" and got[23]["text"] == "plain & text" and got[24]["text"] == "a b" and got[21]["n_chars"] == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_trusted_texts_meet_their_ids_the_same_way_at_any_size(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    found = ngram_ratio.trusted_texts(docs, labels)
    assert sorted((r["doc_id"], r["text"] or "") for r in found.collect()) == [(2, "b"), (2, "c"), (3, "")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan and "SortMergeJoin" not in plan
