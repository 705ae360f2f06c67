"""The ten operators against brute force, over one table of awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from quarrymill.llm import bpe, htmltext, jaccard, langid, lm, media, mixing, quality, substrings, tokenfiles
from quarrymill.llm import textkernel as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, home int, set long, size string, kept string"


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def make_rows(seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Und", "der", "é", "naïve", "x1", "it's", "ＡＢ", "日本語", "a b", "#*", "<|endoftext|>"] + [f"w{i}" for i in range(60)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [sentence(n) for n in (1, 2, 3, 4, 5, 6, 19, 20, 21, 40, 80, 150, 150, 300)]
    passage = sentence(70)
    texts = [None, "", " \t\n\x0b\f\r ", "word", *base, base[-1], base[-1], base[5], base[2]]
    for _ in range(12):  # near copies
        w = base[-1].split(" ")
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [f"{sentence(rng.randrange(30))} {passage}\n{sentence(rng.randrange(30))}" for _ in range(5)]
    texts += [" ".join(["again and again"] * 40), "line one\nline one\n\n line\nline one", "x" * 70_000, f"{sentence(9000)}  {passage} "]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t or ""), 7, 8, "clash", None) for i, t in zip(ids, texts, strict=True)]
    return [*rows, rows[7], rows[7], (None, base[3], None, None, 1, 1, 1, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame(rows, SCHEMA).repartition(5)
    made.cache().count()
    return made


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_kernel_words_and_hashes_agree_with_regex(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]).slice(3)
    found = []
    seen = {}
    for _, data, offsets in tk.chunks(batch, size=2000):
        w = tk.words(data, offsets, lower=True)
        raw = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)]
        for x, h in zip(raw, w.hashes.tolist(), strict=True):
            assert seen.setdefault(low(x), h) == h
        found += [raw[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    assert found == [words(t) for t in texts[3:]]
    assert len(set(seen.values())) == len(seen)


# 1 -------------------------------------------------------------------------------------------------------------------


def test_html_keeps_the_article_only(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy this.</div><article><h1>Title &amp; &eacute;</h1><p><b>Bold<br><p>One <i>t</i>wo &lt;3
    five.</p><p>Short.</p><div class="comments"><p>First!</p></div><form><p>Name</p></form></article>
    <aside>Side</aside><div id=cookie-notice>We use cookies</div><footer>&copy; x</footer></body></html>"""
    plain = "<div>Menu</div><p>The cat is on the mat and it was there for a long time with all of the people in the house.</p><p>So.</p>"
    got = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", plain), (4, "u", plain), (5, "u", "<p>x<!-- open")], "page_id long, url string, html string")
    out = sorted((r.page_id, r.text, r.n_chars) for r in htmltext.extract(got).collect())
    assert out[0][:2] == (1, "Title & é Bold One two <3 five. Short.") and out[0][2] == len(out[0][1])
    assert out[1:3] == [(2, "", 0), (3, "", 0)]
    assert out[3] == out[4] and out[3][1].startswith("The cat") and out[3][1].endswith("house. So.")
    assert htmltext.extract(got.limit(0)).collect() == []


def test_html_undecided_blocks_follow_nearest():
    good = htmltext.Block("g", 30, 0.3, 0.0, 0, False, False, False)
    bad = htmltext.Block("b", 5, 0.0, 0.9, 3, False, False, False)
    short = lambda n: htmltext.Block("s", n, 0.0, 0.0, 0, False, False, False)
    assert [b.label for b in htmltext.classify([bad, short(2), short(9), good, short(1), good])] == ["bad", "bad", "good", "good", "good", "good"]


def brute_labels(found):
    """Both passes, block by block, looking at all others."""
    marked = any(b.article and not b.never for b in found)

    def alone(b):
        if b.never or (marked and not b.article):
            return "bad"
        if b.link_density > 0.5:
            return "open" if b.article and b.n_links < 2 else "bad"
        if b.n_words < 12:
            return "open"
        return "good" if b.stop_density >= 0.15 else "bad" if b.stop_density < 0.05 and not b.article else "open"

    first = [alone(b) for b in found]
    out = []
    for i, b in enumerate(found):
        mine = [j for j in range(len(found)) if j != i and first[j] != "open" and (not marked or (found[j].article and not found[j].never))]
        left, right = max((j for j in mine if j < i), default=None), min((j for j in mine if j > i), default=None)
        far = lambda j: sum(x.n_words for x in found[min(i, j) + 1 : max(i, j)] if not marked or (x.article and not x.never))
        edge = [(sum(x.n_words for x in part), "bad") for part in (found[:i], found[i + 1 :])]
        near = [(far(j), first[j]) if j is not None else None if marked else e for j, e in zip((left, right), edge, strict=True)]
        if first[i] != "open":
            out.append(first[i])
        elif None in near:
            out.append(next((x[1] for x in near if x), "good"))
        elif near[0][0] == near[1][0]:
            out.append(near[b.heading][1])
        else:
            out.append(min(near)[1])
    return out


def test_html_labels_against_brute_force():
    rng = random.Random(9)
    for _ in range(600):
        article = rng.random() < 0.5
        found = [
            htmltext.Block("x", rng.choice([1, 2, 3, 3, 8, 12, 30]), rng.choice([0.0, 0.1, 0.3]), rng.choice([0.0, 0.0, 0.0, 0.9]), rng.choice([0, 1, 3]), rng.random() < 0.15, article and rng.random() < 0.7, rng.random() < 0.2)
            for _ in range(rng.randrange(1, 12))
        ]
        want = brute_labels(found)
        assert [b.label for b in htmltext.classify(found)] == want


PROSE = "It was the best of times and it was the worst of times for all of us who were there to see it."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<div class="social-studies"><p>{PROSE}</p></div>', PROSE),
        (f'<div class="search-history post"><p>{PROSE}</p><p>So.</p></div>', f"{PROSE} So."),
        (f'<article><p>{PROSE}</p><div class="comment-list"><p>{PROSE}</p></div><div id="main-sidebar-2">{PROSE}</div></article>', PROSE),
        (f'<p>{PROSE}</p><div class="social-buttons">Tell others</div><p>{PROSE}</p>', f"{PROSE} {PROSE}"),
        ("<article><p>The area is <math><mi>r</mi><mo>*</mo><mi>r</mi></math> now.</p></article>", "The area is r*r now."),
        ("<article><p>See <svg><title>t</title><text>a &amp; b</text></svg> and <object>this</object> <noscript>or that</noscript>.</p></article>", "See a & b and this or that."),
        (f"<body><form><select><option>one<option>two</form><button>Go<article><p>{PROSE}</p></article><article><p>More.</p></article></body>", f"{PROSE} More."),
        (f"<select><option>one<p>{PROSE}</p><button><div>Press</div></button><p>{PROSE}</p>", f"{PROSE} {PROSE}"),
        (f"<textarea>typed <b>x</b><p>{PROSE}</p>" + "<textarea>" * 50_000, PROSE),
        (f"<textarea>typed <p>{PROSE}</p></textarea><p>{PROSE}</p><template><p>{PROSE}</p></template>", PROSE),
        ("<nav><a href=/>Дом</a> <a href=/b>Всё</a></nav><div><h1>Заголовок</h1><p>Мы шли по длинной улице весь день, и никто не знал, куда она ведёт нас.</p><p>Да.</p><p>Вечером пошёл дождь, "
         "река поднялась, люди вышли на берег и долго смотрели на воду и огни.</p></div><footer>Все права</footer>",
         "Заголовок Мы шли по длинной улице весь день, и никто не знал, куда она ведёт нас. Да. Вечером пошёл дождь, река поднялась, люди вышли на берег и долго смотрели на воду и огни."),
        ("<ul><li><a href=/>家</a><li><a href=/b>本</a></ul><p>今日はとても良い天気なので、私たちは朝から山へ歩いて行きました。</p><p>夕方には雨が降り始めて、みんなで急いで家へ帰ることにしました。</p>",
         "今日はとても良い天気なので、私たちは朝から山へ歩いて行きました。 夕方には雨が降り始めて、みんなで急いで家へ帰ることにしました。"),
    ],
)
def test_html_keeps_articles_whatever_their_names_elements_and_language(html, want):
    assert htmltext.main_text(html) == want


def test_html_needs_no_article_tag(spark):
    """The same page with and without the tag; prose beside the article, long pages, and columns of any name."""
    prose = "It was the best of times and it was the worst of times for all of us who were there to see it."
    body = f"<h1>A title</h1><p>{prose}</p><p>Short.</p><p>{prose}</p>"
    page = "<nav><a href=/>Home</a> <a href=/b>B</a></nav>{0}<footer>Imprint of the house</footer>"
    want = f"A title {prose} Short. {prose}"
    pages = [page.format(f"<article>{body}</article>"), page.format(f"<div>{body}</div>"), page.format(f"<article>{body}</article><div><p>{prose}</p></div>")]
    pages.append(page.format(f"<article>{f'<p>{prose}</p>' * 20_000}</article>"))
    rows = [(i, p, "u", "clash") for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id int, html string, url string, text string")).collect()}
    assert got == {0: want, 1: want, 2: want, 3: " ".join([prose] * 20_000)}


# 2 -------------------------------------------------------------------------------------------------------------------


def brute_classes(rows, k, num, den):
    sets = []
    for r in rows:
        w = words(low(r[1] or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), min(least[find(i)], default=r[0])) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("k", "num", "options"), [(4, 85, {}), (5, 80, {"block_sets": 2, "local_star": 1}), (2, 75, {"block_sets": 3, "block_grams": 500}), (5, 80, {"bucket_bytes": 2_000})])
def test_jaccard_classes(docs, rows, k, num, options):
    got = jaccard.classes(docs, k, num, 100, **options).collect()
    want = brute_classes(rows, k, num, 100)
    blank = {r[0] for r in rows if not words(r[1])}
    assert sorted(map(tuple, got), key=str) == [x if x[0] not in blank else (x[0], 0, x[0]) for x in want]


def test_jaccard_many_links_in_small_blocks(spark):
    rng = random.Random(3)
    made = []
    for _ in range(3):
        base = [f"v{rng.randrange(1000)}" for _ in range(60)]
        for _ in range(25):  # chains: each a little further from the first
            base[rng.randrange(60)] = f"v{rng.randrange(1000)}"
            made.append((len(made), " ".join(base)))
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    want = brute_classes(made, 3, 80, 100)
    for options in ({}, {"block_sets": 5, "local_star": 1}):
        assert sorted(map(tuple, jaccard.classes(frame, 3, 80, 100, **options).collect()), key=str) == want
    assert len({x[2] for x in want}) < 60


def test_jaccard_trie_finds_each_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = [np.sort(np.unique(np.concatenate([rng.permutation(base)[: rng.integers(25, 41)], rng.integers(0, 1 << 63, rng.integers(0, 8), dtype=np.uint64)]))) for _ in range(60)]
    links = jaccard.link_family(list(range(60)), sets, 80, 100)
    parent = list(range(60))

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    true = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                true[find(true, i)] = find(true, j)
    for a, b in links:
        parent[find(parent, a)] = find(parent, b)
    names = lambda p: [min(j for j in range(60) if find(p, j) == find(p, i)) for i in range(60)]
    assert names(parent) == names(true)


def test_jaccard_rejects_low_thresholds(docs):
    with pytest.raises(ValueError, match="threshold"):
        jaccard.classes(docs, 4, 50, 100)


def test_drop_near_copies_keeps_one_of_each(docs, rows, empty):
    got = jaccard.drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    want = sorted({d for d, n, c in brute_classes(rows, 5, 80, 100) if d is not None and (c == d or not words(next(r[1] for r in rows if r[0] == d)))})
    assert kept == want
    assert jaccard.classes(empty).collect() == []


def test_drop_near_copies_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y"), (3, "other words are in this one", 9, "z"), (3, "other words are in this one", 9, "z"), (None, "a b c d e f", 1, "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _gone int, `_TURN` string")
    got = jaccard.drop_near_copies(frame)
    assert got.columns == frame.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[0], rows[2], rows[4]]))


def test_components_state_does_not_overflow(spark):
    from quarrymill.llm.components import _state

    edges = spark.range(20_000_000).selectExpr("id AS u", "id + 1 AS v")
    assert _state(edges)[0] == 20_000_000 and _state(edges) == _state(edges) != _state(edges.limit(19_999_999))


# 3 -------------------------------------------------------------------------------------------------------------------


def test_media_round_trip(docs, rows, empty):
    got = media.digest(docs).collect()
    by_text = defaultdict(set)
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in got:
        raw = text_of[r.doc_id].encode()
        padded = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-16:]) and r.media_bytes == len(media.to_wav(padded))
        by_text[raw].add((r.media_sha256, r.feature))
    assert len(got) == len(rows) and all(len(v) == 1 for v in by_text.values())
    stored = media.to_media(docs.where("doc_id = 1")).first()
    assert media.from_wav(bytes(stored.media)) == media.payload(text_of[1].encode())
    assert media.digest(empty).collect() == []


def test_short_sounds_have_fingerprints():
    """Of at most 192 bytes: none is empty, and different texts differ."""
    texts = ["", "short", "a somewhat longer line of text", "Numbers: 1, 2, 3 and 4", "x" * 150, "the quick brown fox jumps over the lazy dog " * 4]
    marks = [tuple(media.fingerprint(media.payload(t.encode()))) for t in texts]
    assert all(marks) and len(set(marks)) == len(texts)


def test_long_sounds_have_the_fingerprints_of_whole_ones(monkeypatch):
    sound = np.random.default_rng(2).integers(32, 127, 192 * 100, dtype=np.uint8).tobytes()
    whole = media.fingerprint(sound)
    monkeypatch.setattr(media, "CHUNK", 960)
    assert len(whole) and np.array_equal(whole, media.fingerprint(sound))
    tone = (128 + 100 * np.sin(2 * np.pi * 10 * np.arange(192 * 4) / 192)).astype(np.uint8)
    assert media.power(tone).argmax(axis=1).tolist() == [10] * 7


# 4 -------------------------------------------------------------------------------------------------------------------


def test_quality_counts(docs, rows, empty):
    want = {}
    for r in rows:
        t, w = r[1] or "", words(r[1])
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want[r[0]] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))
    got = quality.digest(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == want[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert quality.filter_clean(docs).columns == docs.columns
    assert sorted(str(r.doc_id) for r in quality.filter_clean(docs).collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert quality.digest(empty).collect() == []


def test_quality_keeps_prose_and_rejects_junk(spark):
    prose = "The people of the town were in the square, and it was a day for all of them to be glad of what they had."
    junk = " ".join(f"{w}###" for w in prose.split())
    listed = " | ".join(f"item{i}" for i in range(100))
    got = spark.createDataFrame([(1, prose), (2, junk), (3, listed)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.digest(got).collect()} == {1: True, 2: False, 3: False}


# 5 -------------------------------------------------------------------------------------------------------------------


def test_token_files_round_trip(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenfiles.default_tokenizer())
    path = tokenfiles.write(docs, str(tmp_path / "files"), block_bytes=2000)
    got = sorted(tokenfiles.read(spark, path).collect(), key=lambda r: r.start)
    ids_of = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    text_of = {r[0]: r[1] for r in rows}
    at = 0
    for r in got:
        want = ids_of(text_of[r.doc_id])
        assert (r.start, r.n_tokens, list(np.frombuffer(r.ids, "<u4"))) == (at, len(want), want)
        at += len(want)
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(r[0] for r in rows if r[0] is not None)
    assert spark.read.parquet(f"{path}/blocks").count() > 3
    one = tokenfiles.read(spark, path, doc_id=9).collect()
    assert [list(np.frombuffer(r.ids, "<u4")) for r in one] == [ids_of(text_of[9])] * len(one) and one
    crc = {r.doc_id: r.ids_crc32 for r in tokenfiles.digest(docs).collect()}
    assert crc[9] == zlib.crc32(struct.pack(f"<{len(ids_of(text_of[9]))}I", *ids_of(text_of[9])))
    assert tokenfiles.digest(empty).collect() == []


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenfiles.default_tokenizer())
    rng = random.Random(4)
    alphabet = "aAbZ éÉßİıŒſñ.,!'s\"#1²٣  ́\u0085\u001c中ǅŉ\n<|>_-`~^{}[]@😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(1500)] + ["it's I'LL <|endoftext|>a Café-olé"]
    got = tokenfiles.WordEncoder(tokenfiles.default_tokenizer())([t.encode() for t in texts])
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, ascii(t)


def test_other_tokenizers_encode_whole_texts(docs, rows, spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    name = public_tokenizers.path("byte_bpe_50k.json")
    tok, encode = Tokenizer.from_file(name), tokenfiles.WordEncoder(name)
    assert not encode.wordwise and tokenfiles.WordEncoder(tokenfiles.default_tokenizer()).wordwise
    texts = [r[1] or "" for r in rows if len(r[1] or "") < 5000]
    for t, g in zip(texts, encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    path = tokenfiles.write(docs.where("doc_id < 5"), str(tmp_path / "other"), tokenizer=name)
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in tokenfiles.read(spark, path).collect():
        assert list(np.frombuffer(r.ids, "<u4")) == [*tok.encode(text_of[r.doc_id], add_special_tokens=False).ids, 1]


# 6 -------------------------------------------------------------------------------------------------------------------


def fill(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, over = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        level = left / sum(w[s] for s in over) if over else 0
        capped = {s for s in over if w[s] * level >= 2 * sizes[s]}
        if not capped:
            return target | {s: w[s] * level for s in over}
        for s in capped:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        over -= capped


def test_mixing_targets_and_copies(docs, rows, empty):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = fill(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        rate = want[r.source] / sizes[r.source]
        assert r.copies in (math.floor(rate), math.floor(rate) + 1) and r.copies <= 2
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    expanded = mixing.expand(docs)
    assert expanded.columns == docs.columns and expanded.count() == sum(r.copies for r in got)
    assert sorted(map(str, mixing.digest(docs).collect())) == sorted(map(str, mixing.digest(docs.repartition(2)).collect()))
    assert mixing.digest(empty).collect() == []


def test_mixing_comes_near_targets(spark):
    made = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', 1 + CAST(id % 50 AS INT)) AS text", "concat('s', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 11 END) AS source")
    sums = mixing.digest(made).join(made.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.1 for r in sums)


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(i if i % 10 else None, f"w{i} " * (1 + i % 7), "ab"[i % 2], i, i, i, i, i, i) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, Source_Size int, target int, copies int, _copy int, _source int")
    got = mixing.expand(frame)
    assert got.columns == frame.columns
    left = Counter(tuple(r) for r in got.collect())
    assert set(left) <= set(rows) and max(left.values()) <= 2
    mixed = mixing.mix(frame)
    assert mixed.columns == [*frame.columns, "size_", "source_size_", "target_", "copies_"]
    assert left == Counter({tuple(r)[:9]: r.copies_ for r in mixed.collect() if r.copies_})
    # rows without an id do not share one draw
    nameless = spark.range(400).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('w', id) AS text", "CASE WHEN id % 4 = 0 THEN 'a' ELSE 'b' END AS source")
    assert {r.copies for r in mixing.mix(nameless).where("source = 'b'").collect()} == {1, 2}


def test_mixing_targets_of_huge_sources(spark):
    sizes = {f"s{i:03}": 10**14 + i for i in range(300)}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = fill(sizes)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)


# 7 -------------------------------------------------------------------------------------------------------------------


def test_language_profiles(spark, docs, empty):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    letters = {"xx": "abcdeé", "yy": "mnopqü", "zz": "жшщя"}
    text = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(3, 40)))
    made = [(i, text(letters[lang]), lang) for i, lang in enumerate(rng.choice(list(letters)) for _ in range(300))]
    made += [(1000, "1234 !!", "xx"), (1001, None, "yy"), (1002, "", None), (1003, "abc", None), (1000, "1234 !!", "xx")]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.digest(frame).collect()}
    for i, t, lang in made[:300]:
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "xx"]
    assert langid.digest(frame).count() == len(made)
    assert langid.digest(empty).collect() == []
    assert {r.lang_pred for r in langid.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_letters_beyond_the_basic_plane(spark):
    """They are letters, and none is taken for another one."""
    made = [(i, t, lang) for i, (t, lang) in enumerate([("𐐨𐐩 𐐪𐐫", "dd"), ("aä bb", "en"), ("\U00020061\U00020062", "hh")] * 30)]
    made += [(1000, "𠀀", None), (1001, "😀", None), (1002, "𐐀𐐁", None), (1003, "\U00020061", None), (1004, "a", None)]
    got = {r.doc_id: r.lang_pred for r in langid.digest(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()}
    assert got[1000] != "und" and [got[i] for i in (1001, 1002, 1003, 1004)] == ["und", "dd", "hh", "en"]


@pytest.mark.parametrize("far", [0, 3])
def test_language_counts_agree_with_brute_force(far):
    texts = ["Ab ab", "é日x", "", "q", "😀 a1b"] + ["𠀀", "a𐐀𝒳 b𠀀b", "A\U00020041"][:far]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    owner, grams, n = langid._counts(data, offsets)
    want = Counter()
    points = lambda g: [0 if c == "_" else ord(c) for c in g]
    near = lambda p: (len(p) << 48) | sum(c << 16 * (len(p) - 1 - i) for i, c in enumerate(p))
    wide = lambda p: (1 << 63) | (0x1FFFFF << 42 if len(p) == 2 else 0) | sum(c << 21 * (len(p) - 1 - i) for i, c in enumerate(p))
    code = lambda g: near(points(g)) if max(points(g)) < 1 << 16 else wide(points(g))
    for i, t in enumerate(texts):
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            p = f"_{w}_"
            for size in (1, 2, 3):
                for k in range(len(p) - size + 1):
                    g = p[k : k + size]
                    if g != "_":
                        want[i, code(g)] += 1
    assert dict(zip(zip(owner.tolist(), grams.tolist(), strict=True), n.tolist(), strict=True)) == dict(want)


# 8 -------------------------------------------------------------------------------------------------------------------


def test_byte_bpe(docs, rows, empty, monkeypatch):
    from pyspark.sql import functions as F

    enc = bpe.encoder(bpe.default_ranks())
    text_of = {r[0]: r[1] or "" for r in rows}
    got = bpe.digest(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = enc.encode_ordinary(text_of[r.doc_id])
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text_of[r.doc_id].encode()).hexdigest())
    back = bpe.decode_column(bpe.encode_column(docs.select("doc_id", "text"))).where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary"))
    assert back.count() == 0
    assert bpe.digest(empty).collect() == []
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab  \n\t'll é１12 !?") for _ in range(300))
        parts = list(bpe.pieces(text, 20))
        assert "".join(parts) == text and [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


# 9 -------------------------------------------------------------------------------------------------------------------


def brute_spans(rows, window):
    """By (id, text): words, removed words and the kept text."""
    import xxhash

    digest = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    place = lambda d, t: (d is not None, d or 0, signed(digest(t)) % ((1 << 31) - 2) if d is not None else digest(t) >> 2)
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: place(*x))
    first = {}
    for d, t in order:
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, t, i))
    out = {}
    for d, t in order:
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != (d, t, i) for j in range(i, i + window)}
        out[d, t] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.fixture(scope="module")
def clashes(spark, rows):
    """Ids with other texts, texts of null ids, and columns of the names that the operator would like to use."""
    long = " ".join(f"z{i}" for i in range(30))
    more = [(1, long), (2, long), (2, "short text here"), (2, f"{long} and more"), (None, long), (None, f"so {long}"), (None, long), (3, None), (3, "")]
    made = [(r[0], r[1], 1, "h", None) for r in rows] + [(d, t, 2, "h", None) for d, t in more]
    return made, spark.createDataFrame(made, "doc_id long, text string, n_chars int, _home string, `_DOC` string").repartition(4)


@pytest.mark.parametrize("window", [20, 3])
def test_substring_dedup(clashes, window):
    made, frame = clashes
    want = brute_spans(made, window)
    got = substrings.digest(frame, window).collect()
    tell = lambda d, n, gone, kept: (str(d), n, gone, hashlib.sha256(kept.encode()).hexdigest())
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == sorted(tell(r[0], *want[r[0], r[1] or ""]) for r in made)
    if window == 20:
        out = substrings.dedup(frame)
        assert out.columns == frame.columns
        found = sorted((str(r.doc_id), r.text, r.n_chars, r["_home"]) for r in out.collect())
        kept = [(r[0], want[r[0], r[1] or ""][2]) for r in made]
        assert found == sorted((str(d), t, len(t), "h") for d, t in kept)


@pytest.mark.parametrize("sizes", [{}, {"group_bytes": 60, "block_bytes": 400}])
def test_substring_factors_are_earlier_matches(docs, rows, sizes):
    some = {r[0]: words(r[1]) for r in rows if r[0] is not None}
    want = brute_spans([r for r in rows if r[0] is not None], 20)
    gone = defaultdict(set)
    for f in substrings.factors(docs.where("doc_id IS NOT NULL").coalesce(2), **sizes).collect():
        mine, theirs, end, ref_end = some[f.doc_id], some[f.ref_id], f.start + f.n_words, f.ref_start + f.n_words
        assert mine[f.start : end] == theirs[f.ref_start : ref_end]
        assert f.n_words >= 20 and (f.ref_id, f.ref_start) < (f.doc_id, f.start)
        gone[f.doc_id].update(range(f.start, end))
    assert {d: len(gone[d]) for d in some} == {d: next(x[1] for (i, _), x in want.items() if i == d) for d in some}


def brute_parse(block, width):
    """Greedy longest earlier match, word by word: (text, start, length) of factors of `width` words or more."""
    places = [(t, i) for t, w in enumerate(block) for i in range(len(w))]

    def longest(t, i):
        best = 0
        for u, j in places:
            if (u, j) >= (t, i):
                return best
            n = 0
            while i + n < len(block[t]) and j + n < len(block[u]) and block[t][i + n] == block[u][j + n]:
                n += 1
            best = max(best, n)
        return best

    out = set()
    for t, w in enumerate(block):
        i = 0
        while i < len(w):
            n = longest(t, i)
            if n >= width:
                out.add((t, i, n))
            i += max(n, 1)
    across = {(t, i) for t, i in places if longest(t, i) >= width}
    return out, across


def test_parse_is_the_greedy_longest_match_parse(monkeypatch):
    rng = random.Random(8)
    for _ in range(150):
        width = rng.randrange(2, 6)
        vocabulary = ["a", "b", "é", "ab", "c"][: rng.randrange(2, 6)]
        block = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))] for _ in range(rng.randrange(1, 7))]
        block += [block[0][1:] or ["z"], block[-1] + block[0]]
        factors, across = brute_parse(block, width)
        span, a, b, ref, at = substrings.duplicate_factors([" ".join(w).encode() for w in block], None, width)
        found = list(zip(*(x.tolist() for x in (span, a, b, ref, at)), strict=True))
        assert factors <= {(t, i, j - i) for t, i, j, _, _ in found}
        held = lambda some: {(t, k) for t, i, j in some for k in range(i, j - width + 1)}
        assert held((t, i, j) for t, i, j, _, _ in found) == across
        # what is found beside the factors begins outside of them: at their boundaries
        assert all((t, i) not in held((u, k, k + n) for u, k, n in factors) for t, i, j, _, _ in found if (t, i, j - i) not in factors)
        for t, i, j, u, k in found:
            assert block[t][i:j] == block[u][k : k + j - i] and (u, k) < (t, i)
    # factors and boundaries both come from the parse
    monkeypatch.setattr(substrings, "parse", lambda length, starts, ends: (starts[:0], starts[:0]))
    assert len(substrings.duplicate_factors([b"a b c d a b c d"], None, 3)[0]) == 0


def test_substring_dedup_of_nothing(docs, empty):
    assert substrings.digest(empty).collect() == []
    assert substrings.dedup(docs).count() == docs.count()


# 10 ------------------------------------------------------------------------------------------------------------------


def test_lm_counts_and_probabilities(docs, rows, empty):
    tokens = {i: [*words(low(r[1] or "")), "\0end"] for i, r in enumerate(rows)}
    held = {i: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for i, r in enumerate(rows)}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    want = {r[0]: (held[i], len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[i])) for i, r in enumerate(rows)}
    got = lm.digest(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4] and r.base_score == pytest.approx(want[r.doc_id][4], abs=1e-5)
        assert r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert sorted(map(str, lm.digest(docs).collect())) == sorted(map(str, got))
    assert lm.digest(empty).collect() == []


def test_lm_root_sums_to_one(spark):
    """Over all known words and the unknown one; a pair with an unseen word is the least likely."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(12)]
    train = [(i, " ".join(rng.choice(vocabulary) for _ in range(30)), False) for i in range(40)]
    probe = [(100 + i, f"v3 {w}", True) for i, w in enumerate([*vocabulary, "unseen"])] + [(200, "v3", True)]
    frame = spark.createDataFrame(train + probe, "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r.score for r in lm.score(frame).collect()}
    assert all(-20 < got[k] < 0 for k in range(100, 113)) and got[112] < min(got[k] for k in range(100, 112))
    model, _, _ = lm.train(frame)
    assert model.n_train == 40 * 31 and model.vocabulary == 13
    for k in range(lm.ROUNDS):
        unknown = model.root_of(np.zeros(1), np.zeros(1), k)[0]
        assert model.root[k].sum() + unknown == pytest.approx(1.0)


def by_text(frame):
    return sorted(map(str, frame.collect()))


def test_lm_ways_agree(docs):
    """Common words and pairs scored in place, or all by way of their buckets; hot contexts whole, or dealt out."""
    from pyspark.sql import functions as F

    frame = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)))
    a = {r.doc_id: r for r in lm.score(frame).collect()}
    for options, near in (({"frequent": 5}, 0.1), ({"hot_customers": 50, "bucket_tokens": 2000}, 0.02)):
        b = {r.doc_id: r for r in lm.score(frame, **options).collect()}
        for k, r in a.items():
            assert (r.n_known, r.n_tokens) == (b[k].n_known, b[k].n_tokens)
            assert r.base_score == pytest.approx(b[k].base_score)
        # of words that are not broadcast the first guess differs, and of hot contexts what draws are given
        assert sum(r.score for r in a.values()) == pytest.approx(sum(r.score for r in b.values()), rel=near)


def test_lm_scores_do_not_depend_on_the_cluster(spark, docs):
    """As many buckets and partitions as may be: equal scores, whether contexts are hot or not."""
    from pyspark.sql import functions as F

    frame = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)))
    tokens = lm.common_words(frame)[1].tokens
    width = spark.conf.get("spark.sql.shuffle.partitions")
    for hot in (200_000, 50):
        want = None
        for buckets, partitions in ((1, 3), (2, 2), (8, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            try:
                got = by_text(lm.score(frame.repartition(partitions), bucket_tokens=-(-tokens // buckets), hot_customers=hot))
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", width)
            want = want or got
            assert got == want


def brute_probabilities(texts, probes, vocabulary, sweeps, rng):
    """The model by its definition: customers reseated one by one, contexts and root in turn; averaged predictive probabilities."""
    d, a, rd, ra = lm.DISCOUNT, lm.STRENGTH, lm.ROOT_DISCOUNT, lm.ROOT_STRENGTH
    seats, root = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    size = lambda r: sum(sum(x) for x in r.values())
    tables = lambda r: sum(len(x) for x in r.values())
    root_p = lambda w: (sum(root[w]) - rd * len(root[w]) + (ra + rd * tables(root)) / (vocabulary + 1)) / (ra + size(root))
    chance = lambda u, w: (sum(seats[u][w]) - d * len(seats[u][w]) + (a + d * tables(seats[u])) * root_p(w)) / (a + size(seats[u]))

    def sit(restaurant, dish, discount, new):
        weight = [n - discount for n in restaurant[dish]] + [new]
        at = rng.choices(range(len(weight)), weight)[0]
        if at == len(restaurant[dish]):
            restaurant[dish].append(1)
            return True
        restaurant[dish][at] += 1
        return False

    def leave(restaurant, dish):
        at = rng.choices(range(len(restaurant[dish])), restaurant[dish])[0]
        restaurant[dish][at] -= 1
        if not restaurant[dish][at]:
            del restaurant[dish][at]
            return True
        return False

    def add(u, w):
        if sit(seats[u], w, d, (a + d * tables(seats[u])) * root_p(w)):
            sit(root, w, rd, (ra + rd * tables(root)) / (vocabulary + 1))

    pairs = [p for t in texts for p in zip(["end", *t[:-1]], t, strict=True)]
    for p in pairs:
        add(*p)
    total = [0.0] * len(probes)
    for sweep in range(sweeps):
        for u, w in pairs:
            if leave(seats[u], w):
                leave(root, w)
            add(u, w)
        if sweep >= sweeps // 3:
            total = [x + chance(u, w) for x, (u, w) in zip(total, probes, strict=True)]
    return [x / (sweeps - sweeps // 3) for x in total]


def test_lm_probabilities_agree_with_brute_force(spark):
    """A small corpus: probabilities of pairs against customers that are reseated one by one."""
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(9)]
    follow = {v: rng.choices(vocabulary, k=3) for v in vocabulary}

    def text():
        out = [rng.choice(vocabulary)]
        while len(out) < 15:
            out.append(rng.choice(follow[out[-1]]) if rng.random() < 0.8 else rng.choice(vocabulary))
        return out

    texts = [text() for _ in range(12)]
    probes = [text()[:2] for _ in range(40)] + [["v1", "unseen"], ["unseen", "v2"]]
    rows = [(i, " ".join(t), False) for i, t in enumerate(texts)] + [(100 + i, " ".join(p), True) for i, p in enumerate(probes)]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    seen = len({w for t in texts for w in t}) + 1
    flat = [p for w in probes for p in zip(["end", *w], [*w, "end"], strict=True)]
    chance = iter(brute_probabilities([[*t, "end"] for t in texts], flat, seen, 300, rng))
    want = [sum(math.log10(next(chance)) for _ in range(len(w) + 1)) for w in probes]
    away = [abs(got[100 + i] - x) for i, x in enumerate(want)]
    assert max(away) < 0.35 and sum(away) / len(away) < 0.12, (max(away), sum(away) / len(away))


def test_gibbs_samples_the_posterior():
    """One restaurant of two dishes: the sampled mean number of tables against the exact one."""
    d, strength, p = 0.75, 1.0, np.array([0.3, 0.1])
    c = np.array([6, 4])
    s = lambda n: {1: 1.0} if n == 1 else {t: s(n - 1).get(t - 1, 0) + (n - 1 - t * d) * s(n - 1).get(t, 0) for t in range(1, n + 1)}
    weight = {}
    for a, x in s(6).items():
        for b, y in s(4).items():
            rise = math.prod(strength + d * i for i in range(1, a + b))
            weight[a, b] = rise * x * y * p[0] ** a * p[1] ** b
    mean = sum(w * (a + b) for (a, b), w in weight.items()) / sum(weight.values())
    n = 3000
    many_c, many_p = np.tile(c, n), np.tile(p, n)
    of = np.repeat(np.arange(n), 2)
    whole, key = np.full(n, np.nan), np.arange(2 * n, dtype=np.uint64)
    t = lm.gibbs(many_c, np.ones(2 * n, np.int64), of, many_p, d, strength, np.zeros(n), whole, key, 0, 60)
    assert t.min() >= 1 and (t <= many_c).all()
    assert t.sum() / n == pytest.approx(mean, rel=0.05)


def test_seatings_have_as_many_tables_as_the_posterior():
    """Production sweeps: two dishes against the exact mean, and many of up to a million customers against long runs."""
    d, strength = lm.DISCOUNT, lm.STRENGTH
    weight = []
    for c, p in ((200, 0.05), (800, 0.95)):
        s = np.full(c + 2, -np.inf)
        s[1] = 0.0
        for n in range(1, c):
            t = np.arange(1, n + 2)
            s[t] = np.logaddexp(s[t - 1], s[t] + np.log(np.maximum(n - t * d, 1e-300)))
        weight.append(s[1:-1] + np.arange(1, c + 1) * math.log(p))
    rise = np.array([math.lgamma(strength / d + t) + t * math.log(d) for t in range(1, 1001)])
    log = weight[0][:, None] + weight[1] + rise[np.add.outer(np.arange(1, 201), np.arange(1, 801)) - 1]
    share = np.exp(log - log.max())
    want = (share.sum(1) @ np.arange(1, 201)) / share.sum(), (share.sum(0) @ np.arange(1, 801)) / share.sum()
    n = 400
    of = np.repeat(np.arange(n), 2)
    for t in production(np.tile([200, 800], n), of, n, np.tile([0.05, 0.95], n)):
        assert t[::2].mean() == pytest.approx(want[0], rel=0.15) and t[1::2].mean() == pytest.approx(want[1], rel=0.15)
    zipf = 1 / np.arange(1, 5001)
    zipf /= zipf.sum()
    for total in (10**4, 10**6, 10**7):  # the commonest dish has a tenth
        c = np.random.default_rng(3).multinomial(total, zipf)
        once = (c == 1).sum()
        c, p = c[c > 1], zipf[c > 1]
        of = np.zeros(len(c), np.int64)
        where = (of, p, d, strength, np.array([float(once)]), np.array([np.nan]))
        start = lm.seated(c, *where)
        long = lm.gibbs(c, start, *where, np.arange(len(c), dtype=np.uint64), 9, 600, start)
        for t in production(c, of, 1, p, once):
            assert t.min() >= 1 and (t <= c).all() and t.max() > 100
            assert t.sum() == pytest.approx(long.sum(), rel=0.1) and t[:20].sum() == pytest.approx(long[:20].sum(), rel=0.1)


def production(c, of, n, parent, once=0):
    """The numbers of tables that are averaged, round by round, with parents that stay as they are."""
    key = np.arange(len(c), dtype=np.uint64)
    where = (of, parent, lm.DISCOUNT, lm.STRENGTH, np.full(n, float(once)), np.full(n, np.nan))
    t = lm.seated(c, *where)
    for k in range(lm.ROUNDS):
        t = lm.gibbs(c, t, *where, key, k, lm.SWEEPS, t)
        if k in lm.SAMPLED:
            yield t
