import re
from collections import Counter

from tests.llm.frames import documents, prose
from tidemark.llm import host_rules

TEXTS = [
    None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", prose(200), "one two three\n" * 30,
    "#a $b %c\n\n \n#a $b %c", "é ü\x0bö\x1cq r", "a b c d a b c e f d a b", prose(60) + "\n" + prose(60),
]


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_measures(spark):
    df = documents(spark, [(i, t, None, "h") for i, t in enumerate(TEXTS)]).selectExpr("*", "1 AS host", "2 AS w")
    got = {r.doc_id: r for r in host_rules.judge(df, host_limit=1.0).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        want = measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)


def test_host_shares_are_shrunk(spark):
    """A large bad host is rejected, a host with one bad page is pulled to the others."""
    data = [(k, "short", None, "bad") for k in range(60)]
    data += [(1000 + 40 * h + k, prose(60, k) if k else "short", None, f"h{h}") for h in range(9) for k in range(40)]
    data += [(5000, "tiny", None, "one"), (5001, prose(60), None, "bad"), (5002, prose(70), None, None)]
    rows = host_rules.measured(documents(spark, data), "source")
    shares = {r.host: r for r in host_rules.host_verdicts(rows).collect()}
    assert shares["bad"].rejected and shares["bad"].short > 0.9
    assert not shares["one"].rejected and shares["one"].short < 1.0
    assert abs(shares["h1"].short - 1 / 40) < 0.05 and not shares[None].rejected
    judged = {r.doc_id: r for r in host_rules.judge(documents(spark, data)).collect()}
    assert not judged[5001].kept and not judged[5001].base_failed
    assert judged[1001].kept and judged[5002].kept


def test_hosts_that_differ_by_chance_share_one_rate(spark):
    data = [(k, "short" if k % 10 == k // 10 else prose(60, k), None, f"h{k // 10}") for k in range(60)]
    rows = host_rules.measured(documents(spark, data), "source")
    assert {round(r.short, 6) for r in host_rules.host_verdicts(rows).collect()} == {0.1}


def test_empty_table(spark):
    assert host_rules.judge(documents(spark, [(1, "a")]).limit(0)).count() == 0
