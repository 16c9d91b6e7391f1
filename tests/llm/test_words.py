"""Phrase mining, spelling variants and language identification against brute force, SQL and edge cases."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

from tidemark.llm import collocations, common, language_id, queries, spelling, vectors

LOWER = str.maketrans(common.UPPER, common.LOWER)
LONG_A, LONG_B = "ab" * 60, "ab" * 30 + "x" + "ab" * 30
REPEATED = "z" * 90
ROWS = [
    (1, "New York is big. New York is far; New York!", "en", "a"),
    (2, "new YORK is big: the new york is\tnew\x0byork is", "en", "a"),
    (2, "new YORK is big: the new york is\tnew\x0byork is", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, "New York new york NEW york", None, None),
    (6, "a a a a a a, a a a", "und", "c"),
    (7, " ".join(f"w{i % 11} w{i % 7}" for i in range(400)), "en", "a"),
    (8, "ÀÉ Été été x straße STRASSE 日本 語日本 語", "fr", "c"),
    (None, "new york is far", "en", None),
    (9, f"{LONG_A} {LONG_A} {LONG_B} {LONG_B} {REPEATED} {REPEATED} {REPEATED}z {REPEATED}z", "de", None),
    (10, "letters letterss lettters leters letters Letters letterz étéétéé étéétéé etéétéé etéétéé " * 7, "de", None),
]
CLASH = ("n", "word", "key", "rank", "lang_pred", "score", "held_out", "phrase", "id", "x")


def texts_of(rows):
    return [(i, t or "", "und" if la is None else la) for i, t, la, _ in rows]


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


def test_queries_equal_sql(spark, duck):
    for name in ("op11_collocations", "op12_spelling_variants"):
        ours, theirs = same_rows(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLES[name])
        assert ours == theirs and ours


def mined(rows, least, longest, top, inside):
    """The definition, word by word."""
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang in texts_of(rows):
        for piece in re.split(r"[.,;:!?\n-\r]", text.translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, words), a in found.items():
        cuts = [(1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        holds = lambda x, w=words: any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))
        if not any(la == lang and len(x) > len(words) and holds(x) and 100 * b >= inside * a for (la, x), b in found.items()):
            out[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang, rows_ in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1)}


@pytest.mark.parametrize(("least", "longest", "top", "inside"), [(2, 3, 2000, 50), (2, 4, 5, 80), (3, 2, 3, 50), (500, 3, 10, 50)])
def test_phrases_by_brute_force(made, least, longest, top, inside):
    found = collocations.mine(made, least=least, longest=longest, top=top, inside=inside)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(mined(ROWS, least, longest, top, inside))


def test_phrases_of_an_empty_table(made):
    assert collocations.mine(made.limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    a, left, right = 3 * 10**14, 7 * 10**14 + 1, 9 * 10**14
    one = spark.createDataFrame([(bytes([1] * 8), "en", "x", left), (bytes([2] * 8), "en", "y", right)], "key binary, lang string, phrase string, a long")
    pair = spark.createDataFrame([(bytes([1] * 8 + [2] * 8), a)], "key binary, a long")
    r = collocations.scored([one], pair, 2).first()
    assert (r.phrase, r.l, r.r, r.score) == ("x y", left, right, 1_000_000 * a * a // (left * right))


def test_ids_agree_and_are_made_anew_where_they_collide(spark, monkeypatch, tmp_path):
    words = ["a", "New", "été", "語" * 9, "x" * 100]
    df = spark.createDataFrame([("fr", w, 1) for w in words], "lang string, word string, n long")
    theirs = {r.word: r.id for r in collocations.with_ids(df, 3).collect()}
    ours = collocations.id_numbers("fr", pa.array([w.encode() for w in words]), 3).view(np.int64)
    assert [theirs[w] for w in words] == ours.tolist()
    real = collocations.with_ids
    monkeypatch.setattr(collocations, "with_ids", lambda c, seed: real(c, seed) if seed else c.withColumn("id", F.lit(7).cast("long")))
    assert collocations.dictionary(common.Staging(spark, "ids"), df)[1] == 1


def test_packed_codes_where_bits_do_not_suffice():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 500) * (1 << 38) for _ in range(3)]
    packed = collocations.packed_codes(columns, 1 << 40)
    assert len(set(packed.tolist())) == len(set(zip(*(c.tolist() for c in columns), strict=True))) == len(set(zip(packed.tolist(), *(c.tolist() for c in columns), strict=True)))


def test_radix_order_and_bit_map(spark):
    keys = np.random.default_rng(2).integers(0, 1 << 64, 5000, dtype=np.uint64)
    keys[::7] = keys[0]
    order = vectors.radix_order(keys)
    assert (order == np.argsort(keys, kind="stable")).all()
    marks = spark.createDataFrame([(int(x),) for x in keys[:2000].view(np.int64)], "mark long")
    bits = vectors.bit_map(marks, "mark")
    assert vectors.may_hold(bits, keys[:2000]).all()
    others = np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64)
    assert vectors.may_hold(bits, others).mean() < 0.01


def spelled(rows, letters, least, factor, divisor):
    """The definition, pair by pair."""
    n = collections.Counter()
    for i, text, _ in texts_of(rows):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % divisor else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}

    def near(u, v):
        if len(u) == len(v):
            return sum(map(str.__ne__, u, v)) == 1
        u, v = sorted((u, v), key=len)
        return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))

    form, rows_ = {}, {}
    for w, c in n.items():
        close = [v for v in n if v != w and near(v, w)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * c else None
        rows_[w] = c, len(close), n[best] if form[w] else None
    out = set()
    for w, (c, k, m) in rows_.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, c, k, m))
    return out


@pytest.mark.parametrize(("letters", "least", "factor", "divisor"), [(7, 2, 10, 31), (3, 1, 2, 3), (2, 1, 2, 1), (1, 1, 1000, 5)])
def test_spelling_by_brute_force(made, letters, least, factor, divisor):
    found = spelling.variants(made, letters=letters, least=least, factor=factor, divisor=divisor)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.collect()} == spelled(ROWS, letters, least, factor, divisor)
    assert found.count() == len(spelled(ROWS, letters, least, factor, divisor))


def test_long_words_meet_each_other(spark):
    """Words of many letters are looked for by id: one replaced letter, one more, and repeated letters."""
    base = "".join(chr(97 + i * 7 % 26) for i in range(300))
    words = [base, base[:150] + "Q" + base[151:], base[:40] + base[41:], "y" * 200, "y" * 201, "y" * 64, "y" * 65, "y" * 66]
    rows = [(i, " ".join([w] * (2 + i)), None, None) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {tuple(r) for r in spelling.variants(df).collect()} == spelled(rows, 7, 2, 10, 31)
    assert spelling.variants(df.limit(0)).count() == 0


def test_colliding_keys_join_nothing():
    words = pa.array(["aaaaaaa", "bbbbbbb", "aaaaaab", "bbbbbb"])
    place = np.array([2 * 6, 2 * 6, 2 * 6 + 1, -1])
    rows, counts, best = spelling.near_in(place, words, np.array([5, 6, 7, 8]))
    assert sorted(zip(rows.tolist(), counts.tolist(), best.tolist(), strict=True)) == [(0, 1, 2), (2, 1, 0)]


def test_crc_of_prefix_and_word():
    words, prefix = ["abcdefg", "étéétéé", "x" * 48], [b"12:", b":"]
    raw = [w.encode()[:48] for w in words]
    at, which = np.array([0, 1, 0, 1, 0, 1]), [0, 0, 1, 1, 2, 2]
    found = spelling.crc_of(np.array([zlib.crc32(p) for p in prefix], np.uint32), at, np.array([zlib.crc32(raw[i]) for i in which], np.uint32), np.array([len(raw[i]) for i in which]))
    assert found.tolist() == [zlib.crc32(prefix[a] + raw[i]) for a, i in zip(at, which, strict=True)]


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 6, 7, 40):
        words = language_id.codewords(n)
        assert (np.abs(words.sum(axis=0)) < n).all()
        apart = [int((a != b).sum()) for i, a in enumerate(words) for b in words[:i]]
        assert min(apart) >= max(1, words.shape[1] // 5)
    assert language_id.buckets_for(4) == 1 << 16 and language_id.buckets_for(1024) == 1 << 12


def test_language_by_brute_force(made):
    """Counts, odds and decoding by dictionaries, one trigram after the other."""
    train = [(t, la) for i, t, la, _ in ROWS if i is not None and t is not None and la is not None and zlib.crc32(str(i).encode()) % 3 != 1 and any(map(str.isalpha, t))]
    codes = language_id.learn(language_id.training(made))
    assert codes.languages == sorted({la for _, la in train})
    size = language_id.buckets_for(len(codes.languages))

    def grams(text):
        raw = b" " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode().lower()) + b" "
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32)) >> (33 - size.bit_length()) for i in range(len(raw) - 2)]

    counts = {la: collections.Counter(g for t, x in train if x == la for g in grams(t)) for la in codes.languages}
    total = {la: sum(c.values()) + 0.5 * size for la, c in counts.items()}

    def odds(text):
        out = []
        for bit in codes.words.T:
            mean = lambda sign, g, bit=bit: np.mean([(counts[la][g] + 0.5) / total[la] for la, b in zip(codes.languages, bit, strict=True) if b == sign])
            out.append(sum(math.log(mean(1, g) / mean(-1, g)) for g in grams(text)) / math.sqrt(len(grams(text))))
        return out

    right = np.zeros(codes.words.shape)
    for t, la in train:
        k = codes.languages.index(la)
        right[k] += np.array(odds(t)) * codes.words[k] > 0
    right /= np.array([[sum(x == la for _, x in train)] for la in codes.languages])
    trust = np.where(right.sum(axis=1, keepdims=True) == 0, 1, right)
    trust = trust * codes.words.shape[1] / trust.sum(axis=1, keepdims=True)
    assert np.allclose(trust, codes.trust)
    found = language_id.identify(made).collect()
    assert len(found) == len(ROWS)
    want = []
    for i, t, _, _ in ROWS:
        held = i is not None and zlib.crc32(str(i).encode()) % 3 == 1
        if not any(map(str.isalpha, t or "")):
            want.append((i, held, "und", 0.0))
            continue
        o = odds(t)
        loss = [sum(w * math.log1p(math.exp(-c * x)) for w, c, x in zip(trust[k], codes.words[k], o, strict=True)) for k in range(len(codes.languages))]
        want.append((i, held, codes.languages[int(np.argmin(loss))], 1 / sum(math.exp(min(loss) - x) for x in loss)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    for ours, theirs in zip(sorted((tuple(r) for r in found), key=key), sorted(want, key=key), strict=True):
        assert ours[:3] == theirs[:3] and ours[3] == pytest.approx(theirs[3], abs=1e-3)


def test_held_out_languages(spark):
    docs = {r.doc_id: r for r in common.documents(spark, SMALL).collect()}
    found = queries.QUERIES["op13_language_id"](spark, SMALL).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and docs[r.doc_id].text and docs[r.doc_id].lang]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in found)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_languages_of_few_tables(spark, made):
    schema = "doc_id long, text string, lang string"
    assert language_id.identify(made.limit(0)).count() == 0
    one = spark.createDataFrame([(2, "only one", "xx"), (3, "12 34", "xx"), (4, None, "xx")], schema)
    codes = language_id.learn(language_id.training(one.withColumn("doc_id", F.lit(0))))
    assert [(r.lang_pred, r.score, r.ambiguous) for r in language_id.predict(one, codes).collect()] == [("xx", 1.0, False), ("und", 0.0, True), ("und", 0.0, True)]
    none = language_id.learn(language_id.training(one.withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in language_id.predict(one, none).collect()} == {"und"}
    mixed = language_id.Codes(["a", "b"], language_id.codewords(2), np.zeros((1, 5), np.int64), np.ones((2, 1)))
    assert [r.ambiguous for r in language_id.predict(one, mixed).collect()] == [True] * 3
    many = spark.range(language_id.MOST + 1).select(F.concat(F.lit("l"), "id").alias("lang"), F.lit("x").alias("text"))
    with pytest.raises(ValueError):
        language_id.learn(many)
