"""The training-data operators against brute force, round trips and odd inputs."""

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quern.llm import darts, html_tree, licenses, quality, queries, simple8b, suffix_names, tree_model  # noqa: E402
from quern.llm.decontaminate import Rules, _orthogonalise, common_subsequence, contaminated  # noqa: E402
from quern.llm.exact_dedup import deduplicated, exact_duplicates  # noqa: E402
from quern.llm.graph import components  # noqa: E402
from quern.llm.html_extract import extracted, main_text, states, trained  # noqa: E402
from quern.llm.html_tree import Page  # noqa: E402
from quern.llm.labelled_pages import labelled_page  # noqa: E402
from quern.llm.near_dedup import deduplicated as near_kept, near_duplicates  # noqa: E402
from quern.llm.packing import Packer, packed, step_groups  # noqa: E402
from quern.llm.suffix_dedup import repeats_removed  # noqa: E402
from quern.llm.token_count import TokenCounter, token_counts  # noqa: E402
from quern.llm.token_output import read_token_files, write_token_files  # noqa: E402
from quern.llm.tokens import WordEncoder  # noqa: E402
from quern.llm.words import WORD, word_hashes  # noqa: E402

WORD_BPE, PIECE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "  ", "a", " a  b\tc\n<s>\x00 é　x  y ﬁ <unk> <0x0A>", "it's the<|endoftext|>x <|startoftext|>", "İstanbul ΑΣ σ <|endo ftext|>", "áb ≠ a\xa0b\x1cc\x85d\tq\r\n e​f 123abc ½² ǅ ß",
    "don't DON'T ’s _foo_bar a_b é.é É!É ÷× '''s's <|endoftext|>'ll", "日本語 テスト 🎉🎉 ▁▁a ▁b a▁b", "x" * 300 + " " * 40 + "y", "1234 56.78 </s>\n\n b \n",
]


def docs(spark, texts, first=0):
    """Documents with columns whose names clash with those of the operators."""
    rows = [(first + i, t, "x", 1, 2.0, b"") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, start long, score double, bucket binary")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- tokens -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
@pytest.mark.parametrize("most", [1, 2, 50_000, 2**33, 2**62, 2**64 - 1])
def test_simple8b_round_trip(n, most):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, most, n, dtype=np.uint64, endpoint=True)
    ids[rng.random(n) < 0.3] = 0
    payload = simple8b.pack(ids)
    assert (simple8b.unpack(payload) == ids).all()
    for block in range(-(-n // simple8b.BLOCK)):
        assert (simple8b.unpack(payload, block, 1) == ids[block * simple8b.BLOCK : (block + 1) * simple8b.BLOCK]).all()


def library_ids(texts):
    from tokenizers import Tokenizer

    return [Tokenizer.from_file(WORD_BPE).encode(t, add_special_tokens=False).ids for t in texts]


def test_word_encoder_equals_the_library():
    encoder = WordEncoder(WORD_BPE, most=50)
    pool = ["the", "Ing", " ", "\n", "'s", "é", "É", "Σ", "#", ".", "12", "<|endoftext|>", "\t", "日", "́", "<", "|", ">"]
    r = random.Random(1)
    texts = ODD + ["".join(r.choices(pool, k=r.randint(1, 20))) for _ in range(300)]
    for text, ids in zip(texts, library_ids(texts)):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, text


def test_token_counter_equals_the_library(monkeypatch):
    import sentencepiece

    model, counter = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), TokenCounter(PIECE_BPE, most=50)
    pool = ["a", "th", "e", " ", "  ", "\n", "é", "日", "▁", "1", "#", ".", "ing", "\t"]
    r = random.Random(2)
    texts = ODD + ["".join(r.choices(pool, k=r.randint(1, 25))) for _ in range(1500)]
    assert [counter.count(t) for t in texts] == [len(model.encode(t)) for t in texts]
    monkeypatch.setattr("quern.llm.token_count.pieces", lambda t: __import__("quern.llm.common", fromlist=["pieces"]).pieces(t, 7))
    assert [counter.count(t) for t in texts] == [len(model.encode(t)) for t in texts]


def test_token_files(spark, tmp_path):
    texts = [*ODD, None, "long " * 80_000, "end"]
    write_token_files(docs(spark, texts[::-1]).withColumn("doc_id", F.lit(len(texts) - 1) - F.col("doc_id")), str(tmp_path / "t"), WORD_BPE, end_id=2)
    got, start = rows(read_token_files(spark, str(tmp_path / "t"))), 0
    for i, ids in enumerate(library_ids([t or "" for t in texts])):
        raw = np.array([*ids, 2], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids) + 1, zlib.crc32(raw))
        start += len(ids) + 1
    nothing = docs(spark, ["x"]).where("false")
    write_token_files(nothing, str(tmp_path / "none"), WORD_BPE)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_token_counts(spark):
    import sentencepiece

    size = len(sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE).encode("hello world"))
    got = rows(token_counts(docs(spark, [None, "", "hello world", "é " * 5000]), PIECE_BPE))
    assert [(got[i].n_bytes, got[i].n_tokens) for i in (0, 1, 2)] == [(0, 0), (0, 0), (11, size)]
    assert got[3].over_limit and got[3].n_bytes == 15_000
    assert token_counts(docs(spark, ["a"]).where("false"), PIECE_BPE).count() == 0


def test_packing_places_every_id_once(spark, sample):
    texts = [r.text for r in sample.orderBy("doc_id").collect()] + [None, "", "a"]
    got = packed(docs(spark, texts), WORD_BPE, end_id=1).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, ids in enumerate(library_ids([t or "" for t in texts])):
        ids, at = np.array([*ids, 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= parts[0].tier <= 2048
        padding += parts[0].tier - at
    assert padding <= 256 * spark.sparkContext.defaultParallelism


def test_packer_and_step_groups():
    r, packer, done = random.Random(3), Packer((8, 16, 32), batch=10**9), []
    sizes = [r.randint(1, 100) for _ in range(500)]
    for i, n in enumerate(sizes):
        done += packer.add(i, n)
    done += packer.place()
    assert sum(p[2] for s in done for p in s) == sum(sizes)
    assert sum(sum(p[2] for p in s) not in (8, 16, 32) for s in done) <= 1
    costs = [r.randint(1, 1000) for _ in range(640)]
    groups = step_groups(costs, [10] * 640, 100)
    sums = collections.Counter()
    for g, c in zip(groups, costs):
        sums[g] += c
    assert len(sums) == 64 and max(sums.values()) < 1.25 * min(sums.values())


# --- duplicates -------------------------------------------------------------------------------------


def test_exact_duplicates(spark):
    texts = ["Ab c", "aB C", None, "", "É", "é", "x"]
    got = rows(exact_duplicates(docs(spark, texts), keep="largest"))
    assert [(got[i].keep_id, got[i].group_size, got[i].kept) for i in range(7)] == [(1, 2, False), (1, 2, True), (3, 2, False), (3, 2, True), (4, 1, True), (5, 1, True), (6, 1, True)]
    assert got[0].text_sha256 == hashlib.sha256(b"ab c").hexdigest()
    assert sorted(r.doc_id for r in deduplicated(docs(spark, texts)).collect()) == [0, 2, 4, 5, 6]
    twice = docs(spark, ["a"]).unionAll(docs(spark, ["a"])).unionAll(docs(spark, ["a"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert [r.group_size for r in exact_duplicates(twice).collect()] == [3, 3, 3]
    assert [r.doc_id for r in deduplicated(twice).collect()] == [0]
    assert exact_duplicates(docs(spark, ["a"]).where("false")).count() == 0


def test_word_hashes_tell_words_apart(monkeypatch):
    known = {}
    for stretch in (1 << 18, 40):
        monkeypatch.setattr("quern.llm.words._STRETCH", stretch)
        for text in [*ODD, "ab ba aab aba " * 30, "\ud800x \ud800x", "B" * 5000 + " a" + "b" * 5000]:
            words, hashes = WORD.findall(text.lower()), word_hashes(text).tolist()
            assert len(words) == len(hashes)
            assert all(known.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(set(known.values())) == len(known) > 40


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = []
    for m in (0, 20, 60, 150):
        x = base.copy()
        x[:m] = rng.integers(0, 2**63, m, dtype=np.uint64)
        sets.append(darts.cells(x))
    sets.append(darts.cells(np.repeat(base[:1], 5)))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sketch = darts.sketches(np.concatenate(sets), owner, len(sets), 4096)
    for i in range(len(sets)):
        a, b = set(sets[0].tolist()), set(sets[i].tolist())
        assert abs((sketch[0] == sketch[i]).mean() - len(a & b) / len(a | b)) < 0.04


def test_sketches_of_real_weights_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a = rng.exponential(2.0, 300)
    a[:20] = 0
    both = [a, a * rng.choice([0.3, 1.0, 1.7], 300), rng.exponential(2.0, 300)]
    cell, owner, share = zip(*((c, np.full(len(c), i), s) for i, w in enumerate(both) for c, _, s in [darts.weighted_cells(elements, w)]))
    sketch = darts.sketches(np.concatenate(cell), np.concatenate(owner), 3, 4096, np.concatenate(share))
    for i in range(3):
        assert abs((sketch[0] == sketch[i]).mean() - np.minimum(both[0], both[i]).sum() / np.maximum(both[0], both[i]).sum()) < 0.04


def cells_of(text):
    words = re.findall(r"\w+", (text or "").lower())
    width, seen, out = min(5, len(words)), collections.Counter(), set()
    for i in range(len(words) - width + 1 if words else 0):
        s = tuple(words[i : i + width])
        out.add((s, seen[s]))
        seen[s] += 1
    return out


def brute_classes(pairs, threshold=0.8):
    parent = {d: d for d, _ in pairs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, cells_of(t)) for d, t in sorted(pairs)]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and len(x & y) >= threshold * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d in parent}


def near_copies(n, seed=5):
    """A base text with more and more words changed: links of every strength, chains among them."""
    r = random.Random(seed)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(150)]
    out = []
    for i in range(n):
        x = words[:]
        for _ in range(i % 12):
            x[r.randrange(150)] = f"z{r.randint(0, 10**6)}"
        out.append(" ".join(x))
    return out


def test_near_duplicates_equal_brute_force(spark, sample):
    texts = [r.text for r in sample.orderBy("doc_id").limit(120).collect()] + near_copies(90) + [None, "", "!!", "one two", "One, two.", "same words"] + ["same words"] * 3
    got = rows(near_duplicates(docs(spark, texts)))
    wanted = brute_classes(list(enumerate(texts)))
    assert {d: r.class_id for d, r in got.items()} == wanted
    sizes = collections.Counter(wanted.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (d == r.class_id) for d, r in got.items())


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(docs(spark, ["a"]).where("false")).count() == 0
    null = docs(spark, ["a b c"]).withColumn("doc_id", F.lit(None).cast("long"))
    got = near_duplicates(null.unionAll(docs(spark, ["a b c", "a b c"])).unionAll(docs(spark, ["a b c"]))).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.class_size) for r in got) == [(-1, None, 1), (0, 0, 3), (0, 0, 3), (1, 0, 3)]


def test_near_duplicates_of_repeated_and_other_ids(spark):
    base = near_copies(1)[0]
    other = base + " tail"
    far = "nothing like the others at all, not even in part"
    d = spark.createDataFrame([("5", base, 1), ("5", far, 2), ("9", other, 3), ("9", other, 3), ("7", None, 4)], "doc_id string, text string, n int")
    got = sorted((r.doc_id, r.class_id, r.class_size, r.kept) for r in near_duplicates(d).collect())
    assert got == [("5", "5", 1, True), ("5", "5", 3, True), ("7", "7", 1, True), ("9", "5", 3, False), ("9", "5", 3, False)]
    left = near_kept(d)
    assert left.columns == d.columns and sorted(r.n for r in left.collect()) == [1, 2, 4]
    clash = d.withColumn("content", F.lit(1)).withColumn("class_id", F.lit(2))
    assert near_kept(clash).columns == clash.columns and near_kept(clash.where("false")).count() == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (100, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(pairs, length):
    seen, out = set(), {}
    for d, t in pairs:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        kept = bytes(c for c, g in zip(b, covered) if not g)
        spans = sum(1 for i, g in enumerate(covered) if g and not (i and covered[i - 1]))
        out[d] = (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length, block, bucket", [(100, 4000, 3000), (100, 1 << 22, 1 << 22), (20, 500, 400)])
def test_repeats_equal_brute_force(spark, length, block, bucket):
    r = random.Random(length)
    pool = ["".join(r.choices("abcé \n", k=r.randint(1, 250))) for _ in range(12)]
    texts = ["".join(r.choices(pool, k=r.randint(0, 6))) for _ in range(60)] + [None, "", "aé" * 400, "aé" * 400, "aé" * 399, pool[0][:length], pool[0][: length - 1]]
    got = rows(repeats_removed(docs(spark, texts), length, block, bucket))
    assert {d: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for d, x in got.items()} == brute_repeats(list(enumerate(texts)), length)
    assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in got.values())


def test_repeats_of_odd_tables(spark):
    assert repeats_removed(docs(spark, ["a"]).where("false")).count() == 0
    text = "z%dy" * 60
    null = docs(spark, [text]).withColumn("doc_id", F.lit(None).cast("long"))
    got = repeats_removed(docs(spark, [text]).unionAll(docs(spark, [text])).unionAll(null)).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_removed == r.n_bytes) for r in got) == [(-1, False), (0, True), (0, True)]


def test_other_ids(spark, tmp_path):
    """Ids that aren't numbers, or shorter ones, keep their order and their type."""
    texts = ["z%dy" * 60, "b" + "z%dy" * 60, "other " * 40, None, ""]
    for kind, ids in (("string", ["a", "b", "c", None, "d"]), ("smallint", [1, 2, 3, None, 4])):
        d = spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")
        got = {r.doc_id: r for r in repeats_removed(d, 100, 200, 1000).collect()}
        wanted = brute_repeats(list(zip(ids, texts)), 100)
        assert {k: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for k, x in got.items()} == wanted
        write_token_files(d, str(tmp_path / kind), WORD_BPE, end_id=2)
        files = read_token_files(spark, str(tmp_path / kind))
        assert files.schema["doc_id"].dataType.simpleString() == kind
        assert [r.doc_id for r in files.orderBy("start").collect()] == [None, *[i for i in ids if i]]


def test_very_long_texts(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    long = " ".join(r.choices(words, k=200_000))
    item = "a question that nothing else in here asks of anyone. the answer is forty two."
    texts = [long, long + " end", f"{long} {item} {long}", item]
    d = docs(spark, texts)
    assert {x.doc_id: x.class_id for x in near_duplicates(d).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(x.doc_id for x in contaminated(d, bench).collect()) == [2, 3]
    assert {x.doc_id: (x.n_removed, x.n_spans) for x in repeats_removed(d).collect()}[1] == (len(long), 1)
    assert rows(licenses.scanned(d))[2].license is None
    page = spark.createDataFrame([(1, "u", f"<article><p>{long}</p></article>")], "page_id long, url string, html string")
    assert extracted(page).first().text == long


def test_ftrl_equals_a_plain_loop():
    """The vectorised learner and the sparse dot product against the update rule written out for dictionaries."""
    from math import copysign, exp, sqrt

    from quern.llm.ngrams import NGrams

    grams, model = NGrams(), quality.Leader()
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return -(z[i] - copysign(model.l1, z[i])) / ((model.beta + sqrt(n[i])) / model.alpha + model.l2)

    r = random.Random(4)
    for step in range(60):
        text = " ".join(r.choices(["Good", "words,", "BAD!!", "x", "x", "end."], k=r.randint(0, 30)))
        slot, value = grams.features(text)
        x = dict(zip(slot.tolist(), value.tolist())) | {quality.SLOTS: 1.0}
        w = {i: weight(i) for i in x}
        dot = sum(w[i] * v for i, v in x.items())
        assert abs(grams.dot(text, model.weights()) + model.weights()[-1] - dot) < 1e-9
        model.learn(slot, value, step % 2)
        for i, v in x.items():
            g = (1 / (1 + exp(-dot)) - step % 2) * v
            z[i] += g - (sqrt(n[i] + g * g) - sqrt(n[i])) / model.alpha * w[i]
            n[i] += g * g
    assert np.allclose(model.weights()[list(z)], [weight(i) for i in z], atol=1e-9)


# Hand-written pages, not from the generator that the model is trained on, and their main texts.
HAND_PAGES = [
    ("""<html><head><title>Tide tables</title></head><body><div id="top-bar"><a href="/">Harbour Office</a> | <a href="/log">Log in</a></div><div class="content"><h1>How tides work</h1>
      <p>The sea rises and falls twice a day. The moon pulls at it.</p><h2>Spring tides</h2><p>When sun and moon stand in line, the pull adds up.</p><ol><li>Check the table.</li><li>Check it again.</li></ol></div>
      <div class="sidebar"><h3>Popular</h3><ul><li><a href="/a">Knots</a></li><li><a href="/b">Ropes</a></li></ul></div><footer>&copy; 2021 Harbour Office</footer></body></html>""",
     "How tides work\nThe sea rises and falls twice a day. The moon pulls at it.\nSpring tides\nWhen sun and moon stand in line, the pull adds up.\nCheck the table.\nCheck it again."),
    ("""<body><header><nav><a href=/>Home</a><a href=/blog>Blog</a></nav></header><main><article><header><h1>Bread at home</h1></header><p>Flour, water, salt and time are all that it takes, really.</p>
      <blockquote><p>Time does most of the work.</p></blockquote><p>Bake it hot.</p></article><section id="comments"><h2>2 comments</h2><div class="comment"><p>I tried this and it was great, thanks a lot!</p></div></section></main>
      <aside><p>Subscribe to our newsletter for more recipes.</p></aside></body>""",
     "Bread at home\nFlour, water, salt and time are all that it takes, really.\nTime does most of the work.\nBake it hot."),
    ("""<!doctype html><meta charset=utf-8><title>x</title><div class=cookie-banner><p>This site uses cookies to make it better.</p><button>Accept</button></div><ul class=menu><li><a href=1>News</a><li><a href=2>Sport</a></ul>
      <div class=story><h1>Bridge opens after two years</h1><p>The new bridge over the river opened on Monday morning.<p>Traffic was light, the mayor said. &ldquo;We are glad&rdquo;, she added.</div>
      <div class=share-buttons><a href=#>Share</a> <a href=#>Tweet</a></div><div class=related><h4>Read on</h4><a href=3>The old bridge closes</a></div>""",
     "Bridge opens after two years\nThe new bridge over the river opened on Monday morning.\nTraffic was light, the mayor said. “We are glad”, she added."),
    ("""<html><body><div class="wrapper"><div class="ad-slot"><p>Buy cheap shoes here today!</p></div><div class="post"><h2>Notes on glass</h2><p>Glass is not a liquid, whatever old windows seem to show.</p><pre>SiO2
      Na2O</pre><p>It is an amorphous solid.</p></div><form class="search"><label>Search the site</label><input></form></div></body></html>""",
     "Notes on glass\nGlass is not a liquid, whatever old windows seem to show.\nSiO2 Na2O\nIt is an amorphous solid."),
]


def test_hand_written_pages():
    """Blocks right of all blocks, over pages that the generator didn't make."""
    right = total = 0
    for html, wanted in HAND_PAGES:
        blocks, got = [t for _, t in Page(html).blocks], main_text(html, trained()).split("\n")
        want = wanted.split("\n")
        assert all(w in blocks for w in want), [w for w in want if w not in blocks]
        right += sum((b in want) == (b in got) for b in blocks)
        total += len(blocks)
    assert right >= 0.9 * total, (right, total)


def test_covers_hold_every_difference():
    for period, members in suffix_names.COVERS.items():
        assert {(a - b) % period for a in members for b in members} == set(range(period))


# --- quality, pages, benchmark, licences --------------------------------------------------------------


def test_quality_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.scored(d, quality.fit(d, labels)).join(labels, "doc_id")
    held = got.where("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())


def test_labels_held_out_or_hidden_columns_dont_matter(spark):
    texts = ["good text here. " * 5, "BAD!! TEXT!! " * 9] * 20
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(d, labels) == quality.fit(d, flipped)).all()


def test_quality_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    d = docs(spark, [None, "", "a"])
    weights = quality.fit(d, none)
    assert [(r.score, r.predicted) for r in quality.scored(d, weights).collect()] == [(0.5, 0)] * 3
    assert quality.scored(d.where("false"), weights).count() == 0
    assert quality.kept(d, weights).columns == d.columns


def brute_marginals(model, features, parent, kind):
    n, total, ones = len(parent), 0.0, np.zeros(len(parent))
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        score = sum(model.unary[f] for i, fs in enumerate(features) if y[i] for f in fs) + sum(model.edge[kind[i]][y[parent[i]]][y[i]] for i in range(1, n))
        total += np.exp(score)
        ones += np.exp(score) * np.array(y)
    return ones / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = int(rng.integers(1, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        features, kind = [[int(f) for f in rng.integers(0, 5, 2)] for _ in range(n)], [int(k) for k in rng.integers(0, 2, n)]
        model = tree_model.TreeModel(rng.normal(size=5), rng.normal(size=(2, 2, 2)))
        assert np.allclose(model.messages(features, parent, kind)[0], brute_marginals(model, features, parent, kind))


def test_pages_not_trained_on():
    model, right, total = trained(), 0, 0
    for seed in range(5000, 5150):
        page = Page(labelled_page(seed))
        marginal, _ = model.messages(page.features, page.parent, page.kind)
        truth = states(page)
        right += sum((marginal[i] >= 0.5) == bool(truth[i]) for i, _ in page.blocks)
        total += len(page.blocks)
    assert right >= 0.97 * total


def test_extraction(spark):
    html = """<!DOCTYPE html><html><head><title>t</title><script>var a = "<p>x</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
      <div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A&nbsp;title &amp; more</h1><p>First  <b>bold</b>
      text.<p>Second one, unclosed.<br>Same block.</p><ul><li>Item one here.</li></ul></article><section class="comments"><p>Nice post, thanks for writing all of this!</p></section><footer>&copy; someone</footer>"""
    wanted = "A title & more\nFirst bold text.\nSecond one, unclosed. Same block.\nItem one here."
    pages = spark.createDataFrame([(1, "u", html, 0), (2, None, None, 0), (3, "v", "", 0), (3, "v", "", 0)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in extracted(pages).where("page_id <> 2").collect())
    assert got == [(1, "u", wanted, len(wanted)), (3, "v", "", 0), (3, "v", "", 0)]
    assert extracted(pages).where("page_id = 2").first().text == ""
    assert main_text("<p>" * 3000 + "<div>" * 3000, trained()) == ""


def test_unclosed_silent_elements():
    texts = lambda html: [t for _, t in Page(html).blocks]
    article = "<article><h1>A title</h1><p>Some text.</p></article>"
    wanted = ["A title", "Some text."]
    for head in ("<html><head><title>x</title><body>", "<head><meta charset=utf-8><title>x</title><script>var a = '<p>';</script>", "<head><style>p {}</style><body>", "<head><title>x<body>", "<head><title>x</title></head><body>", "<head>", "<head><noscript><p>no</p></noscript>"):
        assert texts(head + article + "</body></html>") == wanted, head
    assert texts("<head><title>x</title>Loose text") == ["Loose text"]
    for tag in sorted(html_tree.SILENT - {"head", "script", "style"}):
        for page in (f"<div>Before <{tag}>silent</div>{article}", f"<body><{tag}>silent{article}</body>", f"<body><{tag}>a<{tag}>silent</body>{article}"):
            assert [t for t in texts(page) if t != "Before"] == wanted, page
        # A closed one is silent with all that is in it.
        assert texts(f"<div>Before<{tag}><div><p>silent</p></div><{tag}>more</{tag}>x</{tag}> after</div><{tag}/>{article}") == ["Before after", *wanted], tag
    for tag in ("script", "style"):
        assert texts(f"{article}<{tag}>var a = '<p>silent</p>';") == wanted
    assert texts("<select><option>a<option>b<p>text</p><select><option>c</option></select>") == ["text"]
    assert texts("<select>" * 3000 + "<p>text") == ["text"]


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 30)), rng.integers(0, 5, rng.integers(0, 40))
        assert common_subsequence(a, b) == slow(a.tolist(), b.tolist())


def test_orthogonalised_in_place():
    thin = np.random.default_rng(8).standard_normal((9000, 6)).astype(np.float32)
    thin[:, 5] = 30 * thin[:, 0] + thin[:, 5]
    before = thin.astype(float)
    _orthogonalise(thin)
    assert np.allclose(thin.T @ thin, np.eye(6), atol=1e-4)
    assert np.allclose(thin @ (thin.T @ before), before, atol=0.05)


def test_benchmark_passages_are_found(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    plain = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    r, texts, wanted = random.Random(6), [], set()
    words = [w for t in plain for w in t.split()]
    for i, (item, text) in enumerate(items.items()):
        own = text.split()
        if i % 3 == 1:  # a paraphrase: every seventh word another one
            own = [r.choice(words) if j % 7 == 3 else w for j, w in enumerate(own)]
        if i % 3 == 2:
            own = " ".join(own).upper().split()
        texts.append(" ".join([*r.choices(words, k=r.randint(0, 90)), *own, *r.choices(words, k=r.randint(0, 90))]))
        wanted.add((i, item))
    clean = [" ".join(r.choices(words, k=120)) for _ in range(60)]
    found = {(x.doc_id, x.item_id) for x in contaminated(docs(spark, [*texts, *clean, None, ""]), bench).collect()}
    assert not {x for x in found if x[0] >= len(texts)}
    assert len(found & wanted) >= 0.95 * len(wanted)
    assert {x for x in wanted if x[0] % 3 != 1} <= found


def brute_contaminated(texts, items, rules=Rules()):
    """(document, item) by the rules alone: every window of every document against every item, no retrieval before."""
    from quern.llm.decontaminate import STEP, WINDOW, _numbers, answer_words

    out = set()
    for item, text in items.items():
        x, n_answer = _numbers(text), answer_words(text)
        count = collections.Counter(x.tolist())
        slack, size = STEP + len(x) // 4, max(len(x), STEP * WINDOW)
        for d, t in enumerate(texts):
            y = _numbers(t or "")
            for start in range(-len(x), len(y), STEP // 2):
                span = y[max(0, start - slack) : max(0, start + size + slack)]
                there = set(span.tolist())
                if not len(x) or sum(n for w, n in count.items() if w in there) < rules.paraphrase * len(x):
                    continue
                lcs = common_subsequence(x, span) / len(x)
                if lcs >= rules.paraphrase and (lcs >= rules.near_verbatim or common_subsequence(x[len(x) - n_answer :], span) / n_answer >= rules.answer):
                    out.add((d, item))
                    break
    return out


def paraphrases(items, words, rates, seed=8):
    """Items among other words, with a share of their words replaced (the answer's last ones stay)."""
    r, texts = random.Random(seed), []
    for i, text in enumerate(items.values()):
        own, rate = text.split(), rates[i % len(rates)]
        for j in r.sample(range(max(1, len(own) - 6)), round(rate * (len(own) - 6)) if len(own) > 6 else 0):
            own[j] = r.choice(words)
        texts.append(" ".join([*r.choices(words, k=r.randint(0, 120)), *own, *r.choices(words, k=r.randint(0, 120))]))
    return texts


def test_retrieval_loses_little_of_an_exhaustive_search(spark, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    plain = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    words = [w for t in plain for w in t.split()]
    texts = paraphrases(items, words, (0.0, 0.1, 0.2, 0.3, 0.38)) + [t[:1500] for t in plain]
    wanted = brute_contaminated(texts, items)
    found = {(x.doc_id, x.item_id) for x in contaminated(docs(spark, texts), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert len(wanted) >= 30 and len(found & wanted) >= 0.9 * len(wanted)
    assert found <= wanted


def test_latent_space_is_that_of_all_passages_of_the_benchmark(spark):
    from quern.llm import decontaminate as dc

    r = np.random.default_rng(4)
    topics = [[f"{t}{i}" for i in range(20)] for t in ("alder", "birch", "cedar", "dogwood")]
    texts = [" ".join(r.choice(topics[t], 45)) for t in r.choice(4, 25_000, p=(0.28, 0.26, 0.24, 0.22))] + ["alder1 birch2", "", None]
    items = dc.numbered(docs(spark, texts), "doc_id")
    idf = r.uniform(1, 3, dc.SLOTS)
    space = dc.latent_space(items, idf, 4)
    passages = [p for x in items.collect() for p in dc._passages(dc._slots(x.words))]
    used, at = np.unique(np.concatenate(passages), return_inverse=True)
    x, row = np.zeros((len(passages), len(used))), np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    np.add.at(x, (row, at), idf[used][at])
    x /= np.sqrt(np.bincount(row, idf[used][at] ** 2))[:, None]
    vectors = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :4]
    assert abs(np.abs((vectors * space[used]).sum(0)) - 1).max() < 1e-5


def test_contamination_of_odd_tables(spark):
    bench = spark.createDataFrame([(1, "a question about a thing. the answer is so.", 0), (2, None, 0), (3, "", 0)], "item_id long, text string, cosine int")
    assert contaminated(docs(spark, ["a"]).where("false"), bench).count() == 0
    assert contaminated(docs(spark, ["a b c", None]), bench.where("false")).count() == 0
    found = contaminated(docs(spark, ["see: A question about a thing? The answer is so!", "x", None]), bench, Rules()).collect()
    assert [(r.doc_id, r.item_id, r.lcs) for r in found] == [(0, 1, 1.0)]
    for id_type, item_type in (("smallint", "decimal(9,0)"), ("binary", "string"), ("date", "tinyint")):
        d = docs(spark, ["see: A question about a thing? The answer is so!"])
        d = d.withColumn("doc_id", F.lit("2024-01-01").cast(id_type) if id_type == "date" else F.lit("7").cast(id_type))
        assert contaminated(d, bench.withColumn("item_id", F.col("item_id").cast(item_type))).count() == 1


def test_contamination_by_a_benchmark_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr("quern.llm.decontaminate.MAX_ITEMS", 2)
    items = [f"item number {w} asks about the {w} of {w}s in a {w} town. it is {w} {w}." for w in ("alder", "birch", "cedar", "dogwood", "elm")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = contaminated(docs(spark, [f"before that {t} and after" for t in items]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(i, i) for i in range(5)}


def test_contamination_of_tiny_tables_and_items_without_a_last_sentence(spark):
    item = "Which river runs through the old town of the painter who drew maps? It is the small one, the Ilse."
    quote = "Name the film that was shot in the harbour in one long summer. “…”"
    bench = spark.createDataFrame([(1, item), (2, quote)], "item_id long, text string")
    found = lambda texts: sorted((r.doc_id, r.item_id) for r in contaminated(docs(spark, texts), bench).collect())
    assert found([item]) == [(0, 1)]
    around = [f"first {w} second {w} third words before {w} {item} then some more about {w}" for w in ("alder", "birch", "cedar")]
    assert found(around) == [(0, 1), (1, 1), (2, 1)]
    assert found([quote, "nothing of these"]) == [(0, 2)]


def test_licences(spark):
    mit = dict(licenses.KNOWN_TEXTS)["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "Licence"), mit[:-20], "story\nReleased under the MIT License.\nmore", "Licensed under the Apache Licence, version 2.0", None, ""]
    got = rows(licenses.scanned(docs(spark, texts)))
    assert [got[i].license for i in range(7)] == ["MIT", "MIT", None, None, "Apache-2.0", None, None]
    assert got[3].notices == ["MIT"] and got[4].notices == ["Apache-2.0"]
    assert [got[i].digest for i in range(5)] == [hashlib.md5(licenses._joined(t).encode()).hexdigest() for t in texts[:5]]
    assert licenses.scanned(docs(spark, ["a"]).where("false")).count() == 0


def test_every_known_notice_is_found_as_a_line(spark):
    notices = [(spdx, s.format(name)) for spdx, names in licenses.NAMES.items() for name in names for s in licenses.SENTENCES]
    single = [(spdx, re.sub(r"\s+", " ", text)) for spdx, text in licenses.KNOWN_TEXTS]
    wanted = notices + single
    got = rows(licenses.scanned(docs(spark, [f"some story\n  # {text}\nmore" for _, text in wanted])))
    assert [got[i].notices for i in range(len(wanted))] == [[spdx] for spdx, _ in wanted]


def test_wrapped_licences_and_copyright_statements(spark):
    def wrapped(text, width, prefix):
        return "\n".join(prefix + line for part in text.split("\n") for line in textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False) or [""])

    texts = [(spdx, wrapped(text, width, prefix)) for spdx, text in licenses.KNOWN_TEXTS for width in (20, 40, 66, 72) for prefix in ("", "  ", " * ")]
    # Each line begins with the word.
    texts += [(spdx, re.sub(r" (?=copyright\b)", "\n", text, flags=re.I)) for spdx, text in licenses.KNOWN_TEXTS]
    mit, isc = dict(licenses.KNOWN_TEXTS[:1])["MIT"], licenses.KNOWN_TEXTS[3][1]
    heads = ["Copyright (c) 2020 Someone", "© Some One", "Copyright 2001-2003, Some One Inc.", "Copyright The Foo Authors", "(C) 1999 X", "Portions Copyright by Y", "All rights reserved.", "Copyright © <year> <holder>. All Rights Reserved."]
    texts += [(spdx, f"{head}\n\n{text}") for head in heads for spdx, text in (("MIT", mit), ("ISC", isc))]
    texts += [("MIT", f"Copyright (c) 2020 Someone. All rights reserved. {mit}")]
    said = [("MIT", "Copyright 2020 X Inc. Licensed under the MIT License."), ("GPL-3.0", "(c) 2019 Y, released under GPL-3.0"), ("Apache-2.0", "All rights reserved. SPDX-License-Identifier: Apache-2.0")]
    got = rows(licenses.scanned(docs(spark, [text for _, text in texts + said])))
    assert [got[i].license for i in range(len(texts))] == [spdx for spdx, _ in texts]
    assert [got[len(texts) + i].notices for i in range(len(said))] == [[spdx] for spdx, _ in said]
    lists = ["(c) you must retain\nthe notices", "copyright notice and this permission", "copyright on the work"]
    assert [licenses.canonical_text(t) for t in lists] == ["c you must retain\nthe notices", "copyright notice and this permission", "copyright on the work"]
    assert all(got[i].digest == hashlib.md5(licenses._joined(t).encode()).hexdigest() for i, (_, t) in enumerate(texts + said))


def test_what_is_said_beside_a_licence_counts(spark):
    mit = dict(licenses.KNOWN_TEXTS[:1])["MIT"]
    no = [
        mit + "\n\n本软件不得用于商业用途。", "Коммерческое использование запрещено.\n\n" + mit, mit + "\n\nΧωρίς άδεια.", "Copyright 2020 X, all commercial use forbidden\n\n" + mit,
        "Copyright (c) 2020 X. You may not distribute this.\n\n" + mit, mit + "\nCopyright 2021 Y. Use requires a fee.", "(c) 2020 X, for evaluation only\n\n" + mit, mit.replace("sell", "not sell"),
    ]
    yes = ["Copyright (c) 2020-2023 Jürgen Müller, Ørsted & Søn A/S\n\n" + mit, "© 2019 株式会社サンプル\n\n" + mit, "Copyright 2001 by The Regents of the University of Somewhere.  All rights reserved.\n" + mit, "Copyright © 2020 X <x@y.org>, https://x.org\n" + mit]
    got = rows(licenses.scanned(docs(spark, no + yes)))
    assert [got[i].license for i in range(len(no))] == [None] * len(no)
    assert [got[len(no) + i].license for i in range(len(yes))] == ["MIT"] * len(yes)
    assert licenses.canonical_text("É—é 本 ①") == "é é 本 ①"


def test_licence_sql_on_documents_that_are_licences(spark, tmp_path):
    """The twin on a table in which licences occur, whole and as lines, and what only looks like one."""
    import duckdb

    mit = dict(licenses.KNOWN_TEXTS[:1])["MIT"]
    texts = [t for _, t in licenses.KNOWN_TEXTS] + ["Copyright (c) 2020 Someone\n\n" + mit, "Copyright 2020 X, no commercial use\n" + mit, mit + "\n本软件", "a story\nReleased under MIT\nthe end", "Copyright 2020 X. Released under the MIT License.", None, "", "copyright law is long\nstory"]
    docs(spark, texts).select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(map(repr, c.execute(licenses.oracle_sql()).fetchall()))
    got = licenses.scanned(spark.read.parquet(str(tmp_path / "d"))).withColumn("notices", F.array_join("notices", ","))
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "digest", "license", "notices").collect()) == want
    assert sum("'MIT'" in x for x in want) >= 5


def test_full_licence_texts_and_further_ones(spark):
    full = licenses.full_texts()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "MIT", "Zlib"} <= {spdx for spdx, _ in full}
    flowed = [(spdx, "\n\n".join(part if re.search(r"copyright (\(c\)|©)", part, re.I) else " ".join(part.split()) for part in text.split("\n\n"))) for spdx, text in full]
    every = full + flowed + [(spdx, re.sub(r"(?m)^", " * ", text.upper())) for spdx, text in full]
    got = rows(licenses.scanned(docs(spark, [text for _, text in every])))
    assert [got[i].license for i in range(len(every))] == [spdx for spdx, _ in every]

    own = "My own licence:\nCopyright 2020 Me\ndo what you like."
    further = spark.createDataFrame([("LicenseRef-own", own), ("LicenseRef-other", own), ("LicenseRef-none", ""), ("LicenseRef-none", None)], "spdx string, text string")
    texts = ["MY OWN LICENSE: do what\nyou like", "", full[0][1], "Released under MIT"]
    got = rows(licenses.scanned(docs(spark, texts), licenses.known_texts(spark).unionByName(further)))
    assert [got[i].license for i in range(4)] == ["LicenseRef-other", None, "MIT", "MIT"]
    assert [r.license for r in licenses.scanned(docs(spark, texts[:1])).collect()] == [None]


# --- queries and pipeline -----------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    result = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    got = queries.QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, result.fetchall()))


def test_scratch_is_removed(spark, tmp_path):
    import os

    from quern.llm import common

    mark = common.scratch_mark()
    df = common.written(spark.range(3))
    table = common.scratch_table(spark.range(4).withColumnRenamed("id", "k").repartition(2, "k"), "k", 2)
    path, name = common._SCRATCH[mark], common._SCRATCH[mark + 1].removeprefix("table ")
    assert (df.count(), table.count()) == (3, 4) and spark.catalog.tableExists(name)
    common.remove_scratch(spark, mark)
    assert not spark.catalog.tableExists(name) and not os.path.exists(path.removeprefix("file:"))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = [d.cache()]
    for _, stage in cp.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf).cache())
        assert kept[-1].columns == d.columns
    ids = [{r.doc_id: r.text for r in k.collect()} for k in kept]
    assert all(b.items() <= a.items() for a, b in zip(ids, ids[1:]))
    assert all(q == 0 or i in ids[1] for i, q in labels.items())
    first = {}
    for i, t in sorted(ids[1].items()):
        first.setdefault(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), i)
    assert set(ids[2]) == set(first.values())
    assert set(ids[3]) == {i for i, c in brute_classes(list(ids[2].items())).items() if i == c}
    texts = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = lambda t: any(f" {' '.join(x)} " in f" {' '.join(re.findall(chr(92) + 'w+', t.lower()))} " for x in texts)
    assert not any(holds(t) for t in ids[4].values())
    assert all(holds(ids[3][i]) for i in ids[3].keys() - ids[4].keys())
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == set(ids[4])


def test_pipeline_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls, repeated ids, other columns and empty tables, stage by stage and in a whole run."""
    import corpus_pipeline as cp

    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    plain = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(8).collect()]
    base = near_copies(1)[0]
    d = spark.createDataFrame(
        [(1, f"before {item} after", "a"), (1, base, "b"), (2, base + " tail", "c"), (None, plain[0], "d"), (3, None, "e"), (3, "", "f"), (4, plain[1], "g"), (4, plain[1], "g")],
        "doc_id long, text string, content string",
    ).withColumns({"_id": F.lit(1), "block": F.lit("x"), "words": F.lit(2.0)})
    kept = lambda df: sorted((r.content for r in df.collect()))
    assert kept(cp.decontamination(spark, d, sf)) == ["b", "c", "d", "e", "f", "g", "g"]
    assert kept(cp.near_dedup(spark, d, sf)) == ["a", "b", "d", "e", "f", "g", "g"]
    assert kept(cp.exact_dedup(spark, d, sf)) in (["a", "b", "c", "d", "e", "g"], ["a", "b", "c", "d", "f", "g"])
    assert {r.doc_id for r in cp.packing(spark, d, sf).collect()} == {None, 1, 2, 3, 4}
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, d, sf).columns == d.columns
        assert stage(spark, d.where("false"), sf).count() == 0
    assert cp.packing(spark, d.where("false"), sf).count() == 0


def test_a_task_gives_back_what_it_held(monkeypatch):
    import public_tokenizers
    from quern.llm import common
    from quern.llm.tokens import WordEncoder

    done = []
    monkeypatch.setattr(common, "release", lambda: done.append(True))
    assert list(common.slim(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and done == [True]
    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    ids = encoder.encode("Some words, other words")
    assert encoder.words and encoder.words.units
    encoder.forget()
    assert not encoder.words and not encoder.words.units and not encoder.words.units.old
    assert encoder.encode("Some words, other words") == ids
