from __future__ import annotations

import random
import re
import string
from collections import Counter

from edge import SCHEMA, documents, frame, prose
from pyspark.sql import functions as F

from tickloom.llm.automata import FuzzyLexicon
from tickloom.llm.secrets import ACCESS, HEX, Novelty, base_spans, find_secrets, novel_spans, redact, redact_secrets, scan_secrets
from tickloom.llm.toxicity import BASE_TERMS, ToxicModel, _candidates, _cover, _preference, bucket_of, drop_toxic, fit_toxicity, score_toxicity


def plain_base(text):
    """The three patterns as they are written down."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        out += [(m.start(), m.end(), "assign")] * (len(m[2]) >= 12)
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "toſen", "Key", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "0123456789abcdef", "ABCDEFGH01", "deadbeef", "xyz", "é", "😀", "-._/", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert sorted(base_spans(text)) == plain_base(text), text
    assert ACCESS.search("AKIA" + "A" * 14) and not ACCESS.search("AKIA" + "A" * 13) and HEX.search("a" * 16)


def test_novelty():
    n = Novelty()
    rng = random.Random(2)
    noise = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    found = find_secrets(f"# the signing credential is {noise} for the host", n)
    assert [(s[2]) for s in found] == ["novel"]
    assert find_secrets(f"an unrelated {noise} stands here", n) == []
    assert find_secrets("private authorization_authentication_configuration1 in code", n) == []
    assert find_secrets("key " + "xy1" * 20, n) == []


def noise(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_short_and_very_long_strings():
    n, rng = Novelty(), random.Random(3)
    b64 = string.ascii_letters + string.digits
    for size in (12, 14, 16, 19):
        found = 0
        for _ in range(50):
            own = "aB7" + noise(rng, b64, size - 3)
            found += find_secrets(f"the bearer {own} came", n) == [(11, 11 + size, "novel")]
        assert found >= 30, (size, found)
    for plain in ("sessionToken1", "accessKeyId2", "client_secret_v2", "Version12Beta", "privateKeyFile1"):
        assert find_secrets(f"the private key {plain} here", n) == []
    long = noise(rng, b64, 5_000)
    text = f"the secret key {long} ends"
    assert find_secrets(text, n) == [(15, 5_015, "novel")] and redact(text, find_secrets(text, n)) == "the secret key [secret] ends"


def test_whole_runs_and_dotted_tokens():
    n, rng = Novelty(), random.Random(8)
    b64 = string.ascii_letters + string.digits + "-_"
    for size in (64, 200, 201, 300):
        own = noise(rng, b64, size)
        text = f"the bearer {own} came"
        assert find_secrets(text, n) == [(11, 11 + size, "novel")], size
        assert redact(text, find_secrets(text, n)) == "the bearer [secret] came"
    signed = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9." + ".".join(noise(rng, b64, k) for k in (120, 43))
    five = "eyJhbGciOiJkaXIiLCJlbmMiOiJBMjU2R0NNIn0.." + ".".join(noise(rng, b64, k) for k in (16, 500, 22))
    for own in (signed, five):
        for tail in ("", ".", ". Then", ".Then we"):
            text = f"authorization: Bearer {own}{tail}"
            assert redact(text, find_secrets(text, n)) == f"authorization: Bearer [secret]{tail}"
    # what a fixed pattern finds in a run leaves the rest of it to the scan
    text = "private key " + noise(rng, b64, 90) + "-" + "0123456789abcdef" * 2 + "-" + noise(rng, b64, 90)
    assert redact(text, find_secrets(text, n)).replace("[secret]", "") == "private key "
    # many sensitive words in one plain run
    assert novel_spans("key1" * 50_000, [], n) == []


def test_novelty_of_long_strings_and_small_alphabets():
    n, rng = Novelty(), random.Random(3)
    for alphabet in (string.digits + "ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"):
        for size in (40, 63, 64, 80, 128, 160, 200, 1200, 5000):
            text = f"the secret key is {noise(rng, alphabet, size)} for now"
            found = find_secrets(text, n)  # sixteen digits in a row are hex too
            assert "novel" in [s[2] for s in found] and redact(text, found).replace("[secret]", "") == "the secret key is  for now", (alphabet, size)
    assert find_secrets("the secret key is " + "xy1" * 200, n) == []
    assert find_secrets("the secret key is " + "authorization_authentication_configuration1_" * 9, n) == []


def test_redact():
    assert redact("abcdefgh", [(1, 3, "x"), (2, 5, "y"), (6, 7, "z")], "*") == "a*f*h"
    assert redact("abc", []) == "abc" and redact("abc", [(0, 3, "x")], "*") == "*" and redact("abcd", [(0, 2, "x"), (2, 4, "y")], "*") == "**"


def test_scan_and_redaction_frames(spark):
    rows = [*documents()[:5], (900, 'x token = "0123456789abcdef0123" y', "en", "s", 1), (900, 'x token = "0123456789abcdef0123" y', "en", "s", 1), (None, None, None, None, None), (901, "", "en", "s", 0)]
    docs = frame(spark, rows).withColumn("found", F.lit(1))
    out = scan_secrets(docs).toPandas()
    assert len(out) == len(rows) and sorted(len(x) for x in out["found"])[-2:] == [2, 2]
    clean = redact_secrets(docs).toPandas()
    assert list(clean.columns) == docs.columns
    hit = clean[clean["doc_id"] == 900]
    assert (hit["text"] == 'x [secret]" y').all() and (hit["n_chars"] == 13).all() and clean["text"].isna().sum() == 1
    assert scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0 and redact_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_matches_edit_distance():
    rng = random.Random(9)
    terms = [("abcab", False, 1), ("bacca", False, 2), ("abc", False, 0), ("cab", True, 0), ("bbaab", True, 1)]
    lexicon = FuzzyLexicon(terms)
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))
        best = []
        for k, (t, prefix, most) in enumerate(terms):
            d = min(distance(w[:n], t) for n in range(len(w) + 1)) if prefix else distance(w, t)
            best += [(d, k)] * (d <= most)
        got = lexicon.match(w)
        assert (got is None) == (not best) and (got is None or got[1] == min(best)[0]), (w, got, best)


def test_quotation_and_misspelling():
    s = ToxicModel([(t, False, 1 if len(t) > 4 else 0) for t in BASE_TERMS]).scorer()
    abuse, spelled, quoted, clean = "you are an idiot", "you are an idiott", 'she said "idiot" to him', "a plain text"
    assert s.score(abuse) > 0.7 > s.score(quoted) > s.score(clean) and s.score(spelled) > s.score(clean) == s.score("")
    assert s.hits(spelled)[0][2] == 1 and s.hits(quoted)[0][3] and s.hits("IDIOT!!")[0][2] == 0


def test_learning(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = prose(rng, 40).split(" ")
        if toxic:
            words.insert(rng.randrange(40), rng.choice(["idiot", "vequ" + rng.choice("abcdefgh") + rng.choice("xyz")]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_toxicity(docs, lab)
    assert any(t.startswith("vequ") and prefix for t, prefix, _ in model.terms)
    out = score_toxicity(docs, model).toPandas().merge(lab.toPandas(), on="doc_id")
    held = out[out["held_out"]]
    assert len(held) > 200 and (held["predicted"] == held["toxic"]).mean() > 0.98 and out["score"].between(0, 1).all()
    # flipped labels of the held-out fold teach nothing
    flipped = lab.withColumn("toxic", F.when(bucket_of("doc_id") == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert fit_toxicity(docs, flipped) == model
    kept = drop_toxic(docs, model).toPandas()
    assert set(kept["doc_id"]) == set(out[out["predicted"] == 0]["doc_id"]) and list(kept.columns) == docs.columns


def test_near_copies_leave_other_terms(spark):
    rng = random.Random(6)
    rare = [f"{noise(rng, string.ascii_lowercase, 10)}" for _ in range(1_400)]
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, 40).split(" ")
        if i < 240:
            words = [*rare, f"copy{i}"]
        elif i < 340:
            words.insert(5, "vequoxin")
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i < 340)))
    model = fit_toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any("vequoxin".startswith(t) for t, _, _ in model.terms)


def test_cover_is_greedy():
    rng = random.Random(7)
    texts = [[f"w{min(int(rng.expovariate(0.2)), 30):02d}x{rng.randrange(3)}" for _ in range(2)] for _ in range(900)]
    strong = sorted({t for words in texts for t in _candidates(words)})
    where = {t: {i for i, words in enumerate(texts) if t in _candidates(words)} for t in strong}
    want = []
    while where:
        best = max(where, key=lambda t: (len(where[t]), -t.count("*"), len(t), t))
        if len(where[best]) < 3:
            break
        gone = where[best]
        want.append(best)
        where = {t: rest for t, own in where.items() if (rest := own - gone)}
    terms = sorted(strong, key=_preference)
    place = {t: i for i, t in enumerate(terms)}
    sets = Counter(tuple(sorted(place[t] for t in _candidates(words))) for words in texts)
    assert len(want) >= 5 and _cover(terms, list(sets), list(sets.values()), 3) == want


def test_no_limit_on_terms(spark):
    """More families than any list would hold: each is learned, and equal texts count by majority."""
    rng = random.Random(11)
    families = [noise(rng, string.ascii_lowercase, 9) for _ in range(350)]
    rows, labels = [], []
    for i in range(17_500):
        toxic = i < 350 * 46
        own = prose(rng, 8) + (" " + families[i % 350] if toxic else "")
        rows.append((i, own, "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    # one text, often: most of its labels say clean
    rows += [(20_000 + i, "same words zzyzx", "en", "s", 1) for i in range(30)]
    labels += [(20_000 + i, 1, int(i % 3 == 0)) for i in range(30)]
    model = fit_toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = [f for f in families if any(f.startswith(t) if prefix else f == t for t, prefix, _ in model.terms)]
    assert len(found) > 300 and not any("zzyzx".startswith(t) for t, _, _ in model.terms)
    assert fit_toxicity(frame(spark, rows[::-1]), spark.createDataFrame(labels[::-1], "doc_id long, quality int, toxic int")) == model


def test_toxicity_edges(spark):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(None, None, "", "", 0), (1, "", "", "", 0), (1, "you moron, you scum", "", "", 0), (1, "you moron, you scum", "", "", 0)], SCHEMA).withColumn("score", F.lit(9))
    model = fit_toxicity(docs, no_labels)
    out = score_toxicity(docs, model).toPandas().sort_values("score")
    assert out["predicted"].tolist() == [0, 0, 1, 1] and out["score"].iloc[0] == out["score"].iloc[1]
    # a very long text is scored whole: its last words count
    long = spark.createDataFrame([(1, "plain words " * 60_000 + "you idiot, you moron", "", "", 0), (2, "plain words " * 60_000, "", "", 0)], SCHEMA)
    assert [r["predicted"] for r in score_toxicity(long, model).orderBy("doc_id").collect()] == [1, 0] and [r["doc_id"] for r in drop_toxic(long, model).collect()] == [2]
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (1, 1, 7)], "doc_id long, quality int, toxic int")
    assert fit_toxicity(docs, odd).terms == model.terms
    assert score_toxicity(spark.createDataFrame([], SCHEMA), model).count() == 0 and drop_toxic(spark.createDataFrame([], SCHEMA), model).count() == 0
