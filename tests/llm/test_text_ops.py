"""Tokens, personal data, quality and language on whole texts."""

import hashlib
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from perinuc.llm import bpe, language_id, pii, quality

FILE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"
CLASH = "doc_id long, text string, lang string, source string, score string, held_out string, ids string, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "a", "b", "c", "d") for i, t, lang in rows], CLASH)


ODD = [(1, None, "en"), (2, "", "en"), (None, "Some words here.", None), (3, "12 34 !!", "en"), (3, "12 34 !!", "en"), (4, "word " * 200_000, "en")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(FILE))


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_bpe_equals_library(library, encoder):
    rng = random.Random(3)
    pool = "aábcdeéfgß ñ'ſİΣσς  \n\t\x85\xa0　中文12٣!?--'s'll\x1c​😀ﬁÅ"
    texts = ["", " ", "<|endoftext|>a<|startoftext|><|endoftext|> B", "ΑΣ ΑΣ.", "don't I'LL we've", "x" * 3000, "ab" * 40_000]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    for text in texts:
        found = library.encode(text, add_special_tokens=False)
        assert ids(encoder, text) == found.ids, text[:100]
        assert encoder.decode(encoder.encode(text)) == library.decode(found.ids, skip_special_tokens=False)


def test_bpe_of_characters_that_python_does_not_know(library, encoder):
    """Unassigned code points, in planes that hold text, beside letters, digits and marks."""
    unknown = [c for c in (*range(0x40000), *range(0xE0000, 0xE0400)) if unicodedata.category(chr(c)) == "Cn"]
    step = [c for k, c in enumerate(unknown) if c < 0x20000 or k % 61 == 0]
    texts = [" ".join(f"A{chr(c)}b1{chr(c)}{chr(c)} 'S" for c in step[k : k + 40]) for k in range(0, len(step), 40)]
    assert [ids(encoder, t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_long_words_merge_like_short_ones(encoder):
    rng, v = random.Random(5), encoder.vocabulary
    for _ in range(300):
        parts = [v.inner[b] for b in bytes(rng.choices(b"aeinrst", k=rng.randint(1, 60)))]
        assert v.merge_scan(list(parts)) == v.merge_heap(list(parts))
    began = time.perf_counter()
    encoder.encode("th" * 100_000)
    assert time.perf_counter() - began < 20


def test_bpe_memory_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 50)
    e = bpe.Encoder(encoder.vocabulary)
    words = " ".join(f"word{k}" for k in range(1000))
    assert e.encode(words) == encoder.encode(words) and len(e) <= 50 and len(e.older) <= 50


def test_bpe_query(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in entry.queries()["op3_bpe"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        found = library.encode(r.text or "", add_special_tokens=False).ids
        plain = library.decode(found, skip_special_tokens=False)
        digests = hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()
        assert got[r.doc_id] == (len(found), *digests)


def test_bpe_odd_rows(spark):
    got = bpe.encode_documents(docs(spark, ODD), FILE, tokens=True).collect()
    assert sorted((repr(r.doc_id), r.n_tokens) for r in got) == sorted(
        [("1", 0), ("2", 0), ("None", 4), ("3", 5), ("3", 5), ("4", 200_000)]
    )
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_documents(docs(spark, []), FILE).count() == 0


# personal data

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(f, text) if good(k, m.group())] for k, f in FORMS.items()}


def test_plain_spans_equal_the_stated_forms():
    rng = random.Random(7)
    for n in range(60_000):
        pool = ("a@.1 23+-(@.9", "1234 -.+567890", "a.b@c-_ +")[n % 3]
        text = "".join(rng.choices(pool, k=rng.randint(0, 45)))
        assert pii.plain(text) == plain_spans(text), text


@pytest.mark.parametrize(
    "text, kind, shown",
    [
        ("write john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("foo[at]bar[dot]org.", "email", "foo[at]bar[dot]org"),
        ("ask a.b at mail dot example dot co dot uk please", "email", "a.b at mail dot example dot co dot uk"),
        ("ｊohn＠exаmple．com x", "email", "ｊohn＠exаmple．com"),
        ("jo​hn@exa​mple.com", "email", "jo​hn@exa​mple.com"),
        ("call plus four four two zero seven nine four six zero nine five eight now", "phone",
         "plus four four two zero seven nine four six zero nine five eight"),
        ("ip 192 dot 168 dot 1 dot 10 end", "ip", "192 dot 168 dot 1 dot 10"),
        ("no: ４５３９ １４８８ ０３４３ ６４６７!", "card", "４５３９ １４８８ ０３４３ ６４６７"),
        ("four five three nine one four eight eight zero three four three six four six seven", "card",
         "four five three nine one four eight eight zero three four three six four six seven"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, shown):
    base, every = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base] == [(kind, shown)]


@pytest.mark.parametrize("text", ["", "look at the dot on the map", "one two at three", "the at the dot of", "(at) (dot) [at]", "Привет мир, как дела"])
def test_clean_texts_stay_clean(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize(
    "text, kind, fragment, whole",
    [
        ("jоhn@example.com", "email", "hn@example.com", "jоhn@example.com"),
        ("to a@b.de, ana@mail.exаmple.com.", "email", "ana@mail.ex", "ana@mail.exаmple.com"),
        ("ana@firma.cоm now", "email", "ana@firma.c", "ana@firma.cоm"),
        ("ana@firma.co (dot) uk", "email", "ana@firma.co", "ana@firma.co (dot) uk"),
        ("call +1 415 555 019９ now", "phone", "+1 415 555 019", "+1 415 555 019９"),
        ("at 192.168.1.1０ now", "ip", "192.168.1.1", "192.168.1.1０"),
    ],
)
def test_fragments_do_not_hide_disguised_identifiers(text, kind, fragment, whole):
    base, every = pii.find(text)
    assert (kind, fragment) in [(k, text[a:b]) for k, a, b in base] and set(base) < set(every)
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base] == [(kind, whole)]


@pytest.mark.parametrize(
    "text, kind, shown",
    [
        ("ask ana at firma dot sk now", "email", "ana at firma dot sk"),
        ("ask ana at firma dot online now", "email", "ana at firma dot online"),
        ("ask ana [at] firma dot sk now", "email", "ana [at] firma dot sk"),
        ("ask ana [at] firma dot berlin now", "email", "ana [at] firma dot berlin"),
        ("ask ana@firma dot berlin now", "email", "ana@firma dot berlin"),
        ("ask ana@mail dot firma dot berlin now", "email", "ana@mail dot firma dot berlin"),
        ("ask ana at firma [dot] berlin now", "email", "ana at firma [dot] berlin"),
        ("call +1 415 five five 5 0199 now", "phone", "+1 415 five five 5 0199"),
        ("call +one 415 555 0199 now", "phone", "+one 415 555 0199"),
        ("call plus one 415 555 0199 now", "phone", "plus one 415 555 0199"),
        ("no: 4539 one 488 0343 six467!", "card", "4539 one 488 0343 six467"),
        ("call +1 415 555 019 nine.", "phone", "+1 415 555 019 nine"),
    ],
)
def test_any_last_label_and_short_spelled_runs(text, kind, shown):
    base, every = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base] == [(kind, shown)]


@pytest.mark.parametrize("text", ["call +1 415 555 0199 one of us", "ana@firma.com dot the letters", "look at the dot to the left", "5 one day"])
def test_prose_beside_identifiers_adds_nothing(text):
    base, every = pii.find(text)
    assert base == every


def test_masks_cover_disguised_identifiers_whole(spark):
    df = spark.createDataFrame([(1, "x jоhn@example.com y")], "doc_id long, text string")
    assert pii.masked(df).first().text == "x " + "█" * 16 + " y"


def test_plain_spans_stay_beside_disguised_ones():
    text = "a@b.de x (at) y (dot) com 1.2.3.4"
    base, every = pii.find(text)
    assert [k for k, _, _ in base] == ["email", "ip"] and set(base) < set(every) and len(every) == 3


def test_personal_data_is_linear():
    began = time.perf_counter()
    pii.find("a@" * 50_000 + "1" * 100_000 + "+1(" * 30_000 + " dot " * 20_000 + "a at b dot " * 10_000 + "(at)" * 20_000 + "one " * 50_000)
    assert time.perf_counter() - began < 20


def test_personal_data_query(spark):
    got = {r.doc_id: r for r in entry.queries()["op9_personal_data"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        spans = plain_spans(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, pii.KINDS.index(k), k, b) for k in spans for a, b in spans[k]))
        found = got[r.doc_id]
        assert [found[f"n_{k}"] for k in pii.KINDS] == [len(spans[k]) for k in pii.KINDS]
        assert found.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(found.spans.split(",")) or not joined


def test_personal_data_odd_rows(spark):
    df = docs(spark, [*ODD, (9, "x a@b.de y", "en")])
    assert sorted((repr(r.doc_id), r.spans) for r in pii.detect(df).collect())[-2:] == [("9", "email:2:8"), ("None", "")]
    covered = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert covered[9] == "x ██████ y" and covered[1] is None
    assert pii.masked(df).columns == df.columns and pii.detect(docs(spark, [])).count() == 0


# quality and language


def kept_away(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_held_out(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op6_language"](spark, SF).collect()
    assert len(got) == len(rows) and all(r.held_out == kept_away(r.doc_id) and 0 <= r.score <= 1 for r in got)
    asked = [r for r in got if r.held_out and rows[r.doc_id].lang]
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in asked]) > 0.95


def plain_bits(texts, data, order):
    """Code length of bytes under one language, straight from the definition."""
    pad = b" " * order
    stream = pad + pad.join(texts) + pad
    count = {}
    for size in range(1, order + 2):
        for k in range(len(stream) - size + 1):
            count[stream[k : k + size]] = count.get(stream[k : k + size], 0) + 1
    after = {}
    for s, n in count.items():
        after.setdefault(s[:-1], {})[s[-1]] = n

    def bits(context, byte):
        seen = after.get(context, {})
        total, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return np.log2((total + kinds) / seen[byte])
        left = np.log2((total + kinds) / kinds) if seen else 0.0
        return left + (bits(context[1:], byte) if context else 8.0)

    whole = pad + data
    return sum(bits(whole[k - order : k], whole[k]) for k in range(order, len(whole)))


def test_code_lengths_are_exact(monkeypatch):
    rng = random.Random(9)
    texts = {name: ["".join(rng.choices(pool, k=60)) for _ in range(5)] for name, pool in (("x", "abcab "), ("y", "bcdde é"))}
    asked = ["abc", "zzz é", "b" * 40, "q", "abé" * 9000]
    coder = language_id.Coder(language_id.fit(texts, 3))
    got = coder.bits(asked)
    for k, name in enumerate(["x", "y"]):
        for i, text in enumerate(asked[:4]):
            want = plain_bits([t.encode() for t in texts[name]], text.encode(), 3)
            assert got[i, k] == pytest.approx(want, rel=1e-5)
    monkeypatch.setattr(language_id, "BLOCK", 1)  # a long text in pieces
    assert coder.bits(asked) == pytest.approx(got, rel=1e-6)


def test_language_odd_rows(spark):
    train = [(k, f"the cat sat on mat {k}", "en") for k in range(20)] + [(100 + k, f"der hund und die katze {k}", "de") for k in range(20)]
    df = docs(spark, [*train, *[(500 + (i or 0), t, lang) for i, t, lang in ODD], (None, "der hund", None)])
    trees = language_id.learn(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, trees).collect()}
    assert got[501] == got[502] == got[503] == ("und", 0.0) and got[None][0] == "de"
    kept = language_id.known_language(df)
    assert kept.columns == df.columns and kept.count() == 43
    none = docs(spark, [])
    assert language_id.identify(none, language_id.learn(none)).count() == language_id.known_language(none).count() == 0
    unknown = docs(spark, [(1, "words", None)])
    assert [tuple(r)[2:] for r in language_id.identify(unknown, language_id.learn(unknown)).collect()] == [("und", 0.0)]


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = entry.queries()["op5_quality"](spark, SF).collect()
    assert all(r.held_out == kept_away(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    asked = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in asked]) > 0.85


def test_quality_is_one_network_over_whole_texts():
    rng = np.random.default_rng(1)
    good = [bytes(rng.choice(list(b"abcdef gh"), 300).astype(np.uint8)) for _ in range(80)]
    bad = [t[:200] + b" ### " + t[200:] for t in good]
    net = quality.train([*good, *bad], [1] * 80 + [0] * 80, 0.0)
    scorer = quality.Scorer(net)
    texts = [b"", b"x", good[0] * 2000, *good[:5], *bad[:5]]
    alone = np.concatenate([scorer.scores([t]) for t in texts])
    assert scorer.scores(texts) == pytest.approx(alone, abs=1e-4)
    # a mark anywhere in a text reaches the pool, also across the border of two chunks
    pooled = [scorer._pooled(*quality._laid_out([b"a" * k + b"###" + b"a" * (400 - k)])).max(axis=0) for k in range(120, 300)]
    assert np.ptp(np.stack(pooled), axis=0) == pytest.approx(0, abs=1e-5)


def test_quality_gradient_falls():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(list(b"abc "), 200).astype(np.uint8)) for _ in range(60)]
    texts = [t if k % 2 else t.replace(b"a", b"#") for k, t in enumerate(texts)]
    p = quality.Scorer(quality.train(texts, [k % 2 for k in range(60)], 0.0)).scores(texts)
    assert ((p > 0.5) == (np.arange(60) % 2 == 1)).mean() > 0.95


def test_quality_odd_rows(spark):
    df = docs(spark, ODD)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (99, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(df, labels)
    assert {r.score for r in quality.score(df, model).collect()} == {1.0}
    both = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(df, quality.learn(df, both)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = docs(spark, [])
    assert quality.score(none, quality.learn(none, labels.limit(0))).count() == 0


def test_fits_learn_from_long_texts(spark):
    rows = [(k, "the little cat sat here and there " * 5, "en", 1) for k in range(60)]
    rows += [(100 + k, "чёрная кошка спит на окне дома " * 400, "ru", 0) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    trees = language_id.learn(frame.select("doc_id", "text", "lang"))
    assert sorted(trees.languages) == ["en", "ru"]
    assert language_id.Coder(trees).predict(["кошка спит"])[0] == ["ru"]
    model = quality.learn(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    assert model.net is not None
