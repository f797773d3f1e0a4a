"""Quality figures against Python, and the counting of shared lines."""

import re
from collections import defaultdict

from ledgerloom.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    filled = [x for x in (text or "").split("\n") if x.strip(BLANK)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(filled) - len(set(filled)),
        len(covered),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check(docs):
    texts = docs.select("doc_id", "text").collect()
    rows = lines.verdicts(docs).collect()
    got = sorted((repr(r["doc_id"]), *(r[n] for n in NAMES)) for r in rows)
    assert got == sorted((repr(r["doc_id"]), *figures(r["text"])) for r in texts)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
        assert r["kept"] in ((False,) if r["base_failed"] else (True, False))


def test_equals_python_on_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_equals_python_on_hostile_texts(hostile):
    check(hostile)


def test_empty_table(empty):
    assert lines.verdicts(empty).count() == 0


def shared(spark):
    own = lambda n, k: " ".join(f"w{n}x{i}" for i in range(k))
    menu = " ".join(f"menu{chr(97 + i)}" for i in range(26)) + " item"
    rows = [(n, f"{own(n, 60)}\n{menu.upper() if n % 2 else menu}  ", "a") for n in range(30)]
    rows += [(100 + n, f"{menu}\n{menu}x\n{own(n, 24)}\n{menu}", "a") for n in range(5)]
    rows += [(200, f"{own(200, 60)}\n{menu}", "b"), (201, f"{own(201, 60)}\n{menu}", None)]
    rows += [(300 + n, own(999, 60), "a") for n in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_common_lines_by_host_over_distinct_documents(spark):
    rows = {r["doc_id"]: r for r in lines.verdicts(shared(spark)).collect()}
    assert all(rows[n]["lost_words"] == 27 and rows[n]["kept"] for n in range(30))
    assert all(rows[100 + n]["lost_words"] == 54 and not rows[100 + n]["kept"] for n in range(5))
    assert rows[200]["lost_words"] == rows[201]["lost_words"] == 0
    assert all(rows[300 + n]["kept"] for n in range(40))  # copies are one document


def test_lines_are_removed(spark):
    docs = shared(spark)
    texts = {r["doc_id"]: r["text"] for r in lines.without_common_lines(docs).collect()}
    assert len(texts) == docs.count()
    assert all("menu" not in texts[n].lower() for n in range(30))
    assert "menu" in texts[200] and "menuax" not in texts[100]


def test_limit_does_not_depend_on_dealing(spark):
    docs = shared(spark)
    a = sorted(map(tuple, lines.verdicts(docs.repartition(7)).collect()))
    assert a == sorted(map(tuple, lines.verdicts(docs.coalesce(1)).collect()))


def test_one_limit_for_hosts_of_every_size(spark):
    """Depleted documents go from a host of 60 and from one of 4,000 texts alike."""
    menu = " ".join(f"menu{i} part" for i in range(30))
    small = [(n, f"{menu}\nown{n} " + " ".join(f"s{n}y{i}" for i in range(19)), "small") for n in range(25)]
    small += [(100 + n, " ".join(f"s{n}z{i}" for i in range(55)), "small") for n in range(35)]
    large = [(1000 + n, f"{menu}\nown{n} " + " ".join(f"l{n}y{i}" for i in range(19)), "large") for n in range(25)]
    large += [(2000 + n, " ".join(f"l{n}z{i}" for i in range(55)), "large") for n in range(3975)]
    docs = spark.createDataFrame(small + large, "doc_id long, text string, source string")
    rows = lines.verdicts(docs).collect()
    gone = {r["doc_id"] for r in rows if not r["kept"]}
    assert gone == {*range(25), *range(1000, 1025)}
    assert not any(r["base_failed"] for r in rows)
