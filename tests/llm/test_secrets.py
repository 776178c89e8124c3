import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from turnwise.llm import secrets


def plain(text):
    """Base spans by the contract's patterns alone."""
    text = text or ""
    found = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def random_key(rng, n, chars=string.ascii_letters + string.digits):
    return "".join(rng.choice(chars) for _ in range(n))


TEXTS = [
    None,
    "",
    "Password: 'hunter2hunter2' and api_key=ABCDEFGH12345678, passwd = short",
    "tokenToken=\"abcdefgh.ijk\" secret : aaaaaaaa= token:=abcdefgh",
    "AKIA" + "A" * 12 + " AKIAAKIA AKIA" + "B" * 40,
    "x" + "0a" * 16 + "g " + "f" * 31 + " " + "deadbeef" * 8 + "é" + "0" * 32,
    "ſecret=abcdefghij SECRET=abcdefghij toKen=abcdefghij",
    "secret=" + "0123456789abcdef" * 2 + " \U0001f600 password=\U0001f600 passwd=abcdefgh",
    "no secrets in a plain sentence, whatever its length may be",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x")], "doc_id long, text string, spans string")
    rows = secrets.digest(secrets.scan(docs)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = plain(TEXTS[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, k in want) for x in ("assign", "access", "hex"))
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert secrets.scan(docs.limit(0)).count() == 0


def test_random_strings_fuzz():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["password", "TOKEN", "api_key", "=", ": ", "'", '"', "AKIA", "ab0", "Z9", " ", "é", "deadbeef" * 4, "\n"]) for _ in range(rng.randint(0, 25)))
        assert secrets.base_spans(text) == plain(text) or sorted(secrets.base_spans(text), key=lambda s: (s[0], secrets.KINDS.index(s[2]))) == plain(text)


def test_the_battery_tells_keys_from_words(spark):
    """Planted random keys are found, and long words, paths and numbers in a row are not."""
    rng = random.Random(6)
    keys = [random_key(rng, n) for n in (40, 44, 64, 88) for _ in range(10)]
    words = ["internationalization_of_user_interfaces_2024", "the-quick-brown-fox-jumps-over-the-lazy-dog-1", "/usr/share/applications/settings/default/file1", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1111", "12345678901234567890123456789012345678901", "----------------------------------------1", "com/example/project/module/controller/v2/impl"]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(1000 + i, f"see {w} here") for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in secrets.scan(docs).collect() if any(s.kind == "random" for s in r.spans)}
    assert len([i for i in found if i < 1000]) >= 0.9 * len(keys)
    assert not [i for i in found if i >= 1000]


ALPHABETS = {
    "hex": "0123456789abcdef", "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "letters": string.ascii_letters, "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase, "base36 upper": string.digits + string.ascii_uppercase, "base62": string.digits + string.ascii_letters,
    "base64": string.digits + string.ascii_letters + "+/", "base64url": string.digits + string.ascii_letters + "-_",
}


@pytest.mark.parametrize("name", ALPHABETS)
def test_recall_by_alphabet_and_length(name):
    """Of 200 random keys of each length 9 in 10 or more are admitted."""
    rng = random.Random(8)
    for n in (20, 24, 32, 48, 64):
        found = [secrets.candidates(random_key(rng, n, ALPHABETS[name]), []) for _ in range(200)]
        counts = {}
        for of_key in found:
            for _, _, b, k in of_key:
                counts[b, k] = counts.get((b, k), 0) + 1
        least = secrets.admitted(counts)
        assert sum(any(k >= least.get(b, secrets.BUCKETS) for *_, b, k in of_key) for of_key in found) >= 180, n


def test_words_are_no_secrets():
    words = [
        "AbstractSingletonProxyFactoryBeanDefinition", "donaudampfschifffahrtsgesellschaftskapitaen", "DONAUDAMPFSCHIFFFAHRTSGESELLSCHAFT", "INTERNATIONALIZATIONFRAMEWORK", "2024-01-02T03-04-05-000001",
        "MAX_CONNECTION_COUNT_LIMIT", "IMG_20240102_030405_HDR_final", "getElementsByClassNameNS2XYZ", "Krankenversicherungskarte2024", "550e8400-e29b-41d4-a716-446655440000", "31415926535897932384626433832795",
    ]
    assert all(k < 8 for w in words for *_, k in secrets.candidates(w, []))  # a chance of 1 % or more


def test_parts_of_runs_in_other_alphabets():
    rng = random.Random(9)
    for _ in range(50):
        key = random_key(rng, 40)
        text = f"v1/{key}_x-y"
        assert any(s <= 3 and e >= 43 and k > 30 for s, e, _, k in secrets.candidates(text, []))


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "password=abcdefghij and rest", "en"), (2, None, "de"), (3, "clean", None)], "doc_id long, text string, lang string")
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "[assign removed] and rest", 2: None, 3: "clean"}
    clash = docs.withColumn("found", F.lit("x")).withColumn("spans", F.lit(1))
    assert secrets.redact(clash).columns == clash.columns and secrets.redact(clash.limit(0)).count() == 0


def test_false_discovery_control():
    """Benjamini-Hochberg over buckets admits what the direct form over p-values admits."""
    counts = {(0, 0): 900, (0, 8): 20, (0, 20): 5, (0, 60): 10}
    p = sorted(10 ** (-k / secrets.PER_DECADE) for (_, k), n in counts.items() for _ in range(n))
    cut = max((x for i, x in enumerate(p) if x <= secrets.FDR * (i + 1) / len(p)), default=0)
    least = secrets.admitted(counts)[0]
    assert [k for (_, k) in counts if k >= least] == [k for (_, k) in counts if 10 ** (-k / secrets.PER_DECADE) <= cut]
    assert secrets.admitted({}) == {}


def test_values_after_names_letters_only_and_rests_of_runs(spark):
    """A key is found behind NAME= and in a query, without digits, and beside a base span; padding stays with its run."""
    rng = random.Random(7)
    key = lambda: random_key(rng, 60)
    forms = [lambda k: f"STRIPE_KEY={k}", lambda k: f"see https://x.example/?sig={k}&a=b", lambda k: f"AWS_SECRET_ACCESS_KEY={k}", lambda k: f"X={k}=="]
    rows = [(f(k), k) for f in forms for k in (key(), key(), key())]
    rows += [(f"see {k} here", k) for k in (random_key(rng, 60, string.ascii_letters) for _ in range(5))]
    rows += [(f"see {k}/AKIA{'A1B2' * 4} here", k) for k in (key(), key(), key())]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    for r in secrets.scan(docs).collect():
        text, k = rows[r.doc_id]
        at = text.index(k)
        assert any(s.kind == "random" and s.start <= at and s.end >= at + len(k) for s in r.spans), text
    words = ["AbstractSingletonProxyFactoryBeanDefinition", "donaudampfschifffahrtsgesellschaftskapitaen", "internationalization_of_user_interfaces", "com/example/project/module/controller/impl"]
    docs = spark.createDataFrame([(i, f"NAME={w}") for i, w in enumerate(words)], "doc_id long, text string")
    assert not any(r.spans for r in secrets.scan(docs).collect())
