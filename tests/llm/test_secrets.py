"""Secrets against the patterns, and the token-efficiency test."""

import hashlib
import random
import re

from ledgerloom.llm import secrets
from ledgerloom.llm.common import vocabulary_path

TOKENS = secrets.encoding(vocabulary_path("byte_bpe_50k.tiktoken"))


def insensitive(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


WORDS = "|".join(insensitive(w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"({WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def check(docs):
    texts = docs.select("doc_id", "text").collect()
    rows = secrets.report(docs).collect()
    want = sorted((repr(r["doc_id"]), hashlib.sha256(",".join(base(r["text"])).encode()).hexdigest()) for r in texts)
    assert sorted((repr(r["doc_id"]), r["base_sha256"]) for r in rows) == want
    for r in rows:
        spans = r["spans"].split(",") if r["spans"] else []
        for kind in ("assign", "access", "hex", "random"):
            assert r[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in spans)


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_hostile_texts(hostile, empty):
    check(hostile)
    assert secrets.report(empty).count() == 0


def test_random_strings_are_told_from_text():
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = ["".join(rng.choice(letters) for _ in range(rng.randrange(24, 60))) for _ in range(300)]
    hit = sum(secrets.is_random(s, TOKENS) for s in drawn)
    assert hit / 300 > 0.95
    plain = [
        "getUserAccountByName2Version", "http2_max_concurrent_streams", "the-quick-brown-fox-2023-edition",
        "550e8400-e29b-41d4-a716-446655440000", "d41d8cd98f00b204e9800998ecf8427e",
        "da39a3ee5e6b4b0d3255bfef95601890afd80709", "12345678901234567890", "loooooooooooooooooooooong",
        "src/main/java/org/example/Parser2/TokenReader", "internationalization", "MAX_BUFFER_SIZE_1024_BYTES",
    ]
    assert [s for s in plain if secrets.is_random(s, TOKENS)] == []


def test_random_string_in_a_text():
    text = "key is q7Xz9LmP2vRt8KwYb4NcJ6hG now"
    assert secrets.find(text, TOKENS) == [("random", 7, 31)]
    text = "token = q7Xz9LmP2vRt8KwYb4NcJ6hG"
    assert [k for k, _, _ in secrets.find(text, TOKENS)] == ["assign"]


def test_redaction(hostile):
    rows = secrets.redact(hostile, length="n_chars")
    assert rows.columns == hostile.columns and rows.count() == hostile.count()
    for r in rows.collect():
        assert base(r["text"]) == [] or "[SECRET]" in r["text"]
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    overlap = "token=" + "ab12" * 10
    assert secrets.without(overlap, secrets.find(overlap, TOKENS), "#") == "#"


def test_random_letters_are_told_from_words():
    rng = random.Random(2)
    lower = "abcdefghijklmnopqrstuvwxyz"
    for letters, least in ((lower + lower.upper(), 0.98), (lower, 0.9), (lower.upper(), 0.9)):
        drawn = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 60))) for _ in range(300)]
        assert sum(secrets.is_random(s, TOKENS) for s in drawn) / 300 > least
    plain = [
        "getUserAccountNameFromSession", "src/app/lib/foo/bar/baz", "a/b/c/d/e/f/g/h/i/j/k/l", "-" * 30,
        "INTERNATIONALIZATION_CONFIG_PATH", "Donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement",
        "keitstlichschenverpf", "XMLHttpRequestEventTarget", "hahahahahahahahahahaha", "to-be-or-not-to-be-that-is",
    ]
    assert [s for s in plain if secrets.is_random(s, TOKENS)] == []
    assert secrets.find("key is qXzLmPvRtKwYbNcJhGdFs now", TOKENS) == [("random", 7, 28)]


def test_recall_by_alphabet_and_length():
    """Strings that hold a letter and a digit; the README has these figures."""
    rng = random.Random(8)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    least = {lower + lower.upper() + digits: 0.97, lower + digits: 0.9, lower.upper() + digits: 0.9}
    for alphabet, share in least.items():
        for length in (12, 14, 16, 18, 19, 20, 24, 31, 40):
            drawn = ["".join(rng.choice(alphabet) for _ in range(length)) for _ in range(400)]
            drawn = [d for d in drawn if any(c.isdigit() for c in d) and any(c.isalpha() for c in d)]
            found = sum(secrets.is_random(d, TOKENS) for d in drawn) / len(drawn)
            assert found >= share, (alphabet, length, found)
    plain = [
        "2023-09-15T10", "20230915T101500Z", "2023-09-15T10-15-00", "http2-server", "version2build", "covid-19-test",
        "iPhone12ProMax", "mp3-player-2020", "chapter10section2", "user_account_42", "utf8_general_ci", "2nd-edition",
        "python3.13/site".replace(".", "_"), "COVID19VACCINE", "base64encoded", "page2/item34/view",
    ]
    assert [p for p in plain if secrets.is_random(p, TOKENS)] == []
