"""Scans, languages, scoring, encoding, URLs, the pipeline and the registered queries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from framewright.llm import bpe_automaton, language_id, personal_data, pitman_yor, secret_scan, url_templates
from framewright.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text,want", [
    ("a john.doe@ex.com b", [("email", "john.doe@ex.com", True)]),
    ("a@b.c@d.e", [("email", "a@b.c", True)]),
    ("jane (at) foo [dot] org", [("email", "jane (at) foo [dot] org", False)]),
    ("bob at mail dot example dot com", [("email", "bob at mail dot example dot com", False)]),
    ("meet at noon, dot your i", []),
    ("аnn@exаmple.com", [("email", "аnn@exаmple.com", False)]),
    ("1.2.3.4.5 and 300.1.1.1", [("ip", "1.2.3.4", True)]),
    ("4111 1111 1111 1111 and 4111 1111 1111 1112", [("card", "4111 1111 1111 1111", True)]),
    ("+1 (555) 555-3824!", [("phone", "+1 (555) 555-3824", True)]),
    ("plus one five five five one two three four", [("phone", "plus one five five five one two three four", False)]),
    ("one nine two dot one six eight dot one dot one", [("ip", "one nine two dot one six eight dot one dot one", False)]),
    ("９９ ｂｏｂ＠ｘ．ｃｏｍ", [("email", "ｂｏｂ＠ｘ．ｃｏｍ", False)]), ("", []), (None, []),
])
def test_personal_spans(text, want):
    assert [(k, text[a:b], base) for k, a, b, base in personal_data.spans(text)] == want


def base_personal(t):
    """The contract's patterns, literally."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m.group().split("."))) <= 255]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15]


def test_personal_base_by_brute_force():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice("ab@@..-+% 0123459()é") for _ in range(rng.randrange(40)))
        t += rng.choice(["", "4111-1111-1111-1111", "+12 345 678 9", "10.0.0.255", "x@y.zz"]) + t[:5]
        assert personal_data.detect(t) == base_personal(t)


def disguised(kind, rng):
    """A plain identifier and a form of it under any mixture of the three kinds of disguise."""
    odd = {"a": "а", "e": "е", "o": "о", "c": "с", "1": "１", "5": "𝟓", "n": "n​", "i": "і"}
    word = dict(zip("0123456789", "zero one two three four five six seven eight nine".split()))
    if kind == "email":
        plain = rng.choice(["john@example.com", "jane.roe@mail.site.org", "n-5@one.net"])
        at, dot = rng.choice([("@", None), ("(at)", "[dot]"), (" [ at ] ", "(.)"), (" at ", " dot "), ("（at）", "."), (" at ", "{dot}"), ("@", " dot ")])
        cut = plain.index("@")
        form = plain[:cut].replace(".", rng.choice([".", dot or "."])) + at + plain[cut + 1:].replace(".", dot or ".")
    else:
        plain = {"ip": "192.168.10.44", "card": "4111111111111111", "phone": "+15550142233"}[kind]
        between = rng.choice([" ", ", ", "-", "\n"])
        if rng.random() < 0.6:
            form = between.join(word.get(c, {"+": "plus", ".": rng.choice(["dot", "point"])}.get(c)) for c in plain).replace("plus" + between, "plus ")
            if kind == "ip":
                form = between.join(between.join(word[c] for c in part) + (rng.choice([" dot", "[dot]", " point"]) if k < 3 else "") for k, part in enumerate(plain.split(".")))
        else:
            form = plain.replace(".", rng.choice([".", "[.]", "(dot)"]))
    return plain, "".join(odd[c] if c in odd and rng.random() < 0.3 else c for c in form)


@pytest.mark.parametrize("kind", ["email", "ip", "card", "phone"])
def test_personal_mixed_disguises(kind):
    rng = random.Random(3)
    for _ in range(1500):
        plain, form = disguised(kind, rng)
        before, after = rng.choice([("Écrire: ", " !"), ("\n<<", ">> fin"), ("ж🙂 | ", " | z")])
        got = [(a, b) for k, a, b, _ in personal_data.spans(before + form + after) if k == kind]
        want = (len(before), len(before) + len(form))
        assert want in got or (form.endswith("​") and (want[0], want[1] - 1) in got), (plain, form, got)


def test_personal_rewriting_by_brute_force():
    """Every step rewritten code point by code point, each carrying the source it came from."""
    rng = random.Random(11)
    bits = ["john", " at ", " dot ", "(at)", "[dot]", "（at）", "example", ".", "com", "@", "а", "​", "one", " ", ", ", "four", "１９２", "plus ", "7", "+", "-", "\n", "five five five five", " "]
    changed = 0
    for _ in range(8000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 16)))
        cells = [(c, i, i + 1) for i, c in enumerate(t)]
        for step in personal_data._chain(t):
            done, at = [], 0
            for start, (a, b, same) in zip(step.begins, step.sources):
                if same:
                    done += cells[a:b]
                else:
                    n = next((x for x in step.begins if x > start), len(step.text)) - start
                    done += [(c, cells[a][1], cells[b - 1][2]) for c in step.text[start:start + n]]
                assert a >= at
                at = b
            cells = done
            assert "".join(c for c, _, _ in cells) == step.text
        plain = "".join(c for c, _, _ in cells)
        base = base_personal(t)
        found = [(k, cells[a][1], cells[b - 1][2], plain[a:b]) for k, a, b in base_personal(plain)]
        want = [(k, a, b) for k, a, b, p in found if t[a:b] != p and not any(k == x and s <= a and b <= e for x, s, e in base)]
        changed += len(want)
        assert [x[:3] for x in personal_data.spans(t)] == base + want
    assert changed > 100


def test_personal_data(messy, messy_rows, empty):
    got = personal_data.personal_data(messy).select("doc_id", personal_data.digest_text("spans")).collect()
    want = [(i, ",".join(f"{k}:{a}:{b}" for k, a, b, _ in personal_data.spans(t))) for i, t in messy_rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert personal_data.personal_data(empty).count() == 0


def test_masked(spark):
    df = spark.createDataFrame([(1, "x a@b.co y +1 555 555 5555"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.text for r in personal_data.masked(df).orderBy("doc_id").collect()] == ["x <EMAIL> y <PHONE>", None, ""]
    df = spark.createDataFrame([(1, "to john（at）exаmple dot com, or j\u200bohn@ex.com!")] * 2, "found long, text string")
    assert [r.text for r in personal_data.masked(df).collect()] == ["to <EMAIL>, or <EMAIL>!"] * 2


def base_secrets(t):
    p = {"assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), "access": (r"()(AKIA[A-Z0-9]+)", 20), "hex": (r"()([0-9a-f]+)", 24)}
    return sorted((m.start(), n, k, m.end()) for n, (k, (x, least)) in enumerate(p.items()) for m in re.finditer(x, t) if len(m.group(2)) >= least)


def test_secrets(spark, messy, messy_rows, empty):
    live, wide, key = "Zx9qLm2Vt7Rw4Kp8", "Example0Key1Value", "AKIA" + "ABCDEFGH12345678"
    texts = [f"é🙂 password = '{live}' end", f"bare {live} here", f"token:{wide}", f"TOKEN={wide} {key}", f"secret=token\"=abcdefgh api-key=abc apikey='{'f0' * 12}'", "secret: short",
             "0123456789abcdef01234567x" + "a" * 30, f"x{live}", "password=password=password=1", None, ""]
    rows = [(i, t, f"s{0 if i < 3 else i}") for i, t in enumerate(texts)] + [(0, texts[0], "s0"), (None, texts[0], None)]
    got = secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    one = {(r.doc_id, i): r for i, r in enumerate(got.collect())}
    assert sorted((r.doc_id or -1, [(s.start, s.k, s.kind, s.end) for s in r.base]) for r in one.values()) == sorted((i if i else i if i is not None and False else (i or -1), base_secrets(t or "")) for i, t, _ in rows)
    got = {r.doc_id: r for r in one.values() if r.doc_id is not None}
    assert got[2].n_example == 1 and got[3].n_example == 1
    assert got[0].n_live == 0 and not got[1].added  # the row without a source makes the value belong to two owners
    got = {r.doc_id: r for r in secret_scan.secrets(spark.createDataFrame(rows[:-1], "doc_id long, text string, source string")).collect()}
    assert got[0].n_live == 1 and [(s.kind, s.start, s.end) for s in got[1].added] == [("assign", 5, 5 + len(live))] and not got[7].added
    res = secret_scan.secrets(messy).select("doc_id", secret_scan.digest_text("base"), "n_live").collect()
    assert sorted(map(tuple, res), key=str) == sorted([(i, ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_secrets(t or "")), 0) for i, t in messy_rows], key=str)
    assert secret_scan.secrets(empty).count() == 0


def test_secret_ownership(spark):
    hot, real, jwt = "Hot5Example9Key2Val", "Real7Key3Vt9Rw4Kp8Q", "eyJhbGciOi1.eyJzdWIiOjEyMzQ1Njc4.c2lnbmF0dXJl9"
    rows = [(i, f"page {i} of notes, password: {hot} and so on", "hot") for i in range(200)] + [(200, f"bare {hot} here", "x")]
    near = "the settings of this machine are kept in one place: password: {} and nobody else should ever read them again"
    rows += [(300, near.format(real + "."), "a"), (301, "Changed title. " + near.format(real + "."), "b"), (302, near.format(real + "."), "c")]
    rows += [(303, f"auth={real} and /srv/{real}/x, x{real}, {real}.", "d"), (400, f"secret = {jwt}", "a"), (401, f"call auth={jwt}.", "e")]
    got = {r.doc_id: r for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[0].n_live, got[0].n_example, got[200].added) == (0, 1, [])
    assert all((got[i].n_live, got[i].n_example) == (1, 0) for i in (300, 301, 302))
    t = {i: x for i, x, _ in rows}
    assert [t[303][s.start:s.end] for s in got[303].added] == [real] * 3 and [t[401][s.start:s.end] for s in got[401].added] == [jwt]


def test_bpe_against_the_library(spark, messy, messy_rows, empty):
    from tokenizers import Tokenizer

    path = bpe_automaton.vocabulary_path()
    library, own, rng = Tokenizer.from_file(path), bpe_automaton.WordBPE(path), random.Random(1)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|end", "it's", "we'll", "Straße", "ΑΣ", "aaaaaaaa", "\u00a0", "İ", "e\u0301", "中文", "\U00012475", "🙂", "½", "\x00"]
    for _ in range(1500):
        t = "".join(rng.choice("aaabbcdeéñ ß\n'stST012!?#…") if rng.random() < 0.8 else rng.choice(pieces) for _ in range(rng.randrange(30)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    got = {(r.doc_id, r.ids_sha256, r.n_tokens) for r in bpe_automaton.encoded(messy, path, digests=True).collect()}
    want = set()
    for i, t in messy_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), len(ids)))
    assert got == want and bpe_automaton.encoded(empty, path).count() == 0


def test_automaton_equals_merging_in_order():
    rng = random.Random(6)
    for _ in range(60):
        symbols = ["a", "b", "c"]
        merges, known = [], list(symbols)
        while len(merges) < 12:
            a, b = rng.choice(known), rng.choice(known)
            if a + b not in known:
                merges.append((a, b))
                known.append(a + b)
        auto = bpe_automaton.Automaton([*symbols, *(s + "$" for s in symbols)], merges, "$")
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
            parts = [*word[:-1], word[-1] + "$"]
            for a, b in merges:
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == (a, b):
                        parts[k:k + 2] = [a + b]
                    k += 1
            assert [auto.labels[t] for t in auto.encode(word)] == parts


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()
    assert set(held.doc_id) == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_language_cases(spark, messy, messy_rows, empty):
    en, fr, de = "the house of the river is here and there ", "la maison de la rivière est dans le bois ", "das haus an der donau ist nicht weit von hier "
    train = spark.createDataFrame([(i, t * (1 + i % 3), a) for i in range(12) for a, t in (("en", en), ("fr", fr), ("de", de))], "doc_id long, text string, lang string")
    model = language_id.fitted(train)
    got = {r.doc_id: r for r in language_id.languages(spark.createDataFrame([(1, en), (2, fr), (3, de), (4, None), (5, " 12!"), (6, "")], "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "fr", "de", "und", "und", "und"] and got[4].score == 0
    rows = language_id.languages(messy, model).collect()
    assert len(rows) == len(messy_rows) and {r.lang_pred for r in rows} <= {"en", "fr", "de", "und"}
    none = language_id.fitted(empty)
    assert {r.lang_pred for r in language_id.languages(messy, none).collect()} == {"und"}
    assert language_id.languages(empty, model).count() == 0
    one = language_id.fitted(train.where("lang = 'en'"))
    assert language_id.identified(messy, one, 0.0).count() == sum(any(c.isalpha() for c in t or "") for _, t in messy_rows)


def test_language_trains_on_whole_texts(spark):
    """One header of 8 000 bytes opens every training text; what tells the languages apart comes after it."""
    en, fr = "the house of the river is here and there ", "la maison de la rivière est dans le bois "
    rows = [(i, "licence and warranty text " * 310 + t * (150 + i), a) for i in range(8) for a, t in (("en", en), ("fr", fr))]
    model = language_id.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [a for a, _ in model.predict([r[1].encode() for r in rows])] == [r[2] for r in rows]


def test_language_sample_is_bounded(spark, monkeypatch):
    """Per language and in all; labels beyond a thousand and repeated rows are nothing special."""
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 3000)
    taken = []
    monkeypatch.setattr(language_id, "_svm", lambda x, y: taken.append(len(y)) or (np.zeros(x.shape[1], np.float32), 0.0))
    language_id.fitted(spark.createDataFrame([(1, "one text", "en")] * 700 + [(i, f"text {i}", "de") for i in range(2000)], "doc_id long, text string, lang string"))
    assert set(taken) == {1200}
    monkeypatch.setattr(language_id, "LanguageModel", lambda x, langs: (x, langs))
    x, langs = language_id.fitted(spark.createDataFrame([(i, f"text {i}", f"l{i % 1500}") for i in range(4500)], "doc_id long, text string, lang string"))
    assert len(langs) == 3000 and len(set(langs)) == 1500 and np.allclose(x.sum(1), 1)


def test_pitman_yor_scores(spark):
    got = QUERIES["op2_pitman_yor"](spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and got[~got.held_out].score.sum() > got[~got.held_out].base_score.sum()


def test_pitman_yor_cases(spark, messy, messy_rows, empty, monkeypatch):
    import pyspark.sql.functions as F

    monkeypatch.setattr(pitman_yor, "MODEL_ROWS", 40)  # several blocks of the model
    got = pitman_yor.scored(messy, F.col("doc_id") % 4 == 1).collect()
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in messy_rows]
    held = [i is not None and i % 4 == 1 for i, _ in messy_rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted([(str(i), h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), ws, h in zip(messy_rows, tokens, held)])
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert pitman_yor.scored(empty, F.lit(False)).count() == 0
    assert pitman_yor.scored(messy, F.lit(True)).count() == len(messy_rows)  # nothing to learn from


def test_pitman_yor_scratch(spark):
    """What is written between the steps stays small beside the texts."""
    from pathlib import Path

    from framewright.session import shared_dir

    files = lambda: {f: f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet") if f.is_file()}
    docs, before = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), files()
    assert pitman_yor.scored(docs, docs.doc_id % 7 == 2).count() == docs.count()
    kept = sum(n for f, n in files().items() if f not in before)
    assert kept < 4 * sum(len((r.text or "").encode()) for r in docs.select("text").collect())


def test_pitman_yor_counts_pairs(spark, monkeypatch):
    """Without discounts and with next to nothing for the parent a training token costs its share of the tokens after the one before it."""
    import pyspark.sql.functions as F

    monkeypatch.setattr(pitman_yor, "BATCH", 300)  # many batches
    monkeypatch.setattr(pitman_yor, "DISCOUNT", (*pitman_yor.DISCOUNT[:6], 0.0))
    monkeypatch.setattr(pitman_yor, "STRENGTH", (*pitman_yor.STRENGTH[:6], 1e-12))
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "B", "the", "é", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(30))) for _ in range(150)] + [None, "", " \t", "a a a"]
    tokens = [[b"", *(t or "").encode().lower().split(), b""] for t in texts]
    held = [i % 5 == 3 for i in range(len(texts))]
    pairs = Counter(x for ws, h in zip(tokens, held) if not h for x in zip(ws, ws[1:]))
    after = Counter(x for ws, h in zip(tokens, held) if not h for x in ws[:-1])
    got = pitman_yor.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id") % 5 == 3).collect()
    for r in got:
        if not r.held_out:
            assert np.isclose(r.score, sum(np.log10(pairs[x] / after[x[0]]) for x in zip(tokens[r.doc_id], tokens[r.doc_id][1:])), atol=1e-6)


def test_pitman_yor_words():
    """Tokens are what bytes.split gives; words keep their bytes and hashes wherever they stand."""
    rng = random.Random(1)
    for _ in range(200):
        texts = [bytes(rng.choice(b" \t\n\r\x0b\x0cabAZ\xc3\xa9\x1f\x85") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 6))]
        got, n = pitman_yor._tokens(texts)
        assert got.to_pylist() == [w for t in texts for w in (*t.lower().split(), b"")] and n.tolist() == [len(t.split()) + 1 for t in texts]
        k = rng.randrange(len(got))
        assert pitman_yor._unpack_words(pitman_yor._pack_words(got[k:])).equals(got[k:])
        assert (pitman_yor._hashes(got[k:]) == pitman_yor._hashes(got)[k:]).all()


def test_long_unknown_words_cost_their_bytes(spark):
    import pyspark.sql.functions as F

    rows = [(i, "some plain words to learn from") for i in range(8)] + [(100 + k, "Qz7" * (1000 * k)) for k in (1, 2, 3)]
    s = {r.doc_id: r.score for r in pitman_yor.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    assert s[101] < -3000 and np.isclose(s[101] - s[102], s[102] - s[103]) and s[101] - s[102] > 3000


def test_no_clustering_decides_a_score(spark):
    """AA + BB and AB + BA hold the same words and pairs when A and B end alike, however unlike their words are."""
    import pyspark.sql.functions as F

    a, b = (" ".join(f"{p}{k % 20}" for k in range(60)) + " z" for p in "qx")
    rows = [(i, (a, b)[i % 2]) for i in range(20)] + [(100 + i, t) for i, t in enumerate((f"{a} {a}", f"{b} {b}", f"{a} {b}", f"{b} {a}"))]
    s = {r.doc_id: r.score for r in pitman_yor.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    assert np.isclose(s[100] + s[101], s[102] + s[103])


def test_word_order(spark):
    """Shuffled words score lower, and what may follow a word has probabilities that add up to less than one."""
    import pyspark.sql.functions as F

    rng = random.Random(3)
    train = [" ".join(rng.choice(("the cat sat down", "a dog ran off", "my bird sang well")) for _ in range(30)) for _ in range(40)]
    vocab = sorted({w for t in train for w in t.split()})
    held = ["the cat sat down a dog ran off", "cat off the dog sat a down ran", "the"] + [f"the {w}" for w in [*vocab, "unseen"]]
    rows = [(i, t) for i, t in enumerate(train + held)]
    s = {r.doc_id - len(train): r.score for r in pitman_yor.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= len(train)).collect()}
    assert s[0] > s[1] + 5
    assert s[3 + vocab.index("cat")] > s[3 + vocab.index("well")] and s[3] < 0
    total = sum(10 ** s[k] for k in range(2, len(held)))
    assert 0 < total < 1


def test_spelling_adds_up_to_one():
    """Bytes after a context, and tables of a dish, have probabilities that add up."""
    words = [pitman_yor._mark(k % 2) + bytes(random.Random(k).choice(b"abcd") for _ in range(1 + k % 6)) for k in range(300)]
    code, n = np.unique(pitman_yor._codes([w + pitman_yor.END for w in words]), return_counts=True)
    tree = pitman_yor._Tree(code, n, np.full(65536, 1 / 256), 1)
    for s in range(6):
        tree.sweep()
        for x in tree.levels:
            assert (x.t >= 1).all() and (x.t <= x.c).all()
            if s > 2:
                x.keep()
    p = tree.probabilities([(x.own / x.samples, x.up / x.samples) for x in tree.levels])
    for k, x in enumerate(tree.levels):
        unseen = np.ones(len(x.ctx_key))
        above = tree.top[(x.key & np.uint64(0xFFFF)).astype(int)] if k == 2 else p[k + 1][tree.parent[k]]
        np.subtract.at(unseen, x.ctx, above)
        total = np.bincount(x.ctx, p[k]) + unseen * x.up / x.samples
        assert np.allclose(total, 1)


def test_table_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 5000)).astype(np.uint64)
    t = pitman_yor._Table(keys, np.arange(len(keys)) + 1.0)
    ask = np.concatenate([keys, keys + np.uint64(1)])
    want = {int(k): i + 1.0 for i, k in enumerate(keys)}
    got, miss = t.get(ask, -1.0)
    assert got.tolist() == [want.get(int(k), -1.0) for k in ask] and set(ask[miss].tolist()).isdisjoint(want)


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?x#y", "https://example.net", "x://y://z/en/", "http://deep.org/fr/a/b/c/d/e/f/g/h", "http://notexample.net/en/", "http://a.example.com/de/1", "http://h.x#f/en/"]
    urls += [f"http://m.test.xyz/spam{'s' if i % 2 else ''}/{i}" for i in range(12)]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_templates.judged(df).collect()}
    assert len(got) == len(urls) + 1
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(10)] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.net", "/en/1", "example.net/en/"), ("example.net", "", None), ("y:", "//z/en/", None),
        ("deep.org", "/fr/a/b/c/d/e/f/g/h", "org/fr/"), ("notexample.net", "/en/", "net/"), ("a.example.com", "/de/1", "example.com/de/"), ("h.x", "", None)]
    assert got[3].verdict == "allow" and got[7].verdict == "block" and got[0].verdict == "allow"
    rules = (("block", "test.xyz", "/spam/"),)
    judged = {r.page_id: r for r in url_templates.judged(df, rules).collect()}
    assert judged[10].verdict == "block" and judged[11].verdict == "allow" and judged[11].template == "m.test.xyz/spams/*"
    assert url_templates.judged(df.where("false")).count() == 0


def test_pipeline_cases(spark, messy, messy_rows, empty):
    docs = messy.select(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, messy if name == "language" else docs, SF)
        docs = out
        if name != "tokens":
            assert out.columns == corpus_pipeline.COLUMNS
    assert docs.columns == ["doc_id", "n_tokens", "ids"]
    ids = [r.doc_id for r in docs.collect()]
    assert 8 in ids and 9 not in ids and 0 not in ids and ids.count(8) == 1
    nothing = empty
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SF)
    assert nothing.count() == 0


def test_registered(spark):
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in names if q.startswith("op")} and "pipeline" in names
    assert names["pipeline"](spark, SF).count() > 100
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twins(spark, name):
    import duckdb

    from tools.check import normal

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert normal(QUERIES[name](spark, SF).toPandas()) == normal(con.sql(SQL[name]).df())
