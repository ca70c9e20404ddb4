import re

import pytest

from tesserae.llm import host_rules as h


@pytest.mark.parametrize("url,host", [("https://www.Example.org:8080/a?b#c", "example.org"), ("http://user:pw@a.b.c./", "a.b.c"), ("//cdn.net/x", "cdn.net"), ("http://[::1]:80/", "[::1]"), ("http://www.org/", "www.org"), ("path/only", None), ("", None), (None, None)])
def test_host_of(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(h.host_of(h.F.col("u"))).first()[0] == host


def counts(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)


def test_counts_against_plain_code(spark):
    texts = [None, "", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n\n \nx", "## 50% <b>", "é ü " * 9, *[" ".join(f"w{(i * k) % 6}" for i in range(40)) for k in range(1, 8)]]
    for r in h.host_rules(spark.createDataFrame([(t, "s") for t in texts], "text string, source string")).collect():
        assert tuple(r[c] for c in h.COUNTS) == counts(r["text"])


def test_pages_by_host(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    judged = h.host_rules(pages.withColumn("host", h.host_of(h.F.col("url"))), text="html", host="host")
    assert judged.count() == pages.count() and judged.filter("host IS NOT NULL").count() > 0
