import re


from tests.llm.frames import documents, rows
from tidemark.llm import personal_data as pd_

TEXTS = [
    None, "", "no data", "a.b+c@x-y.example.org, @x.y a@@b.cc q@r", "x@y.zz@w.vv me@host", "é@a.bé _@1.2",
    "1.2.3.4 999.1.1.1 1.2.3.4.5 0001.002.3.255 1.2.3", "00000000000255.1.1.1 99999999999999999999.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111", "card 4111 1111 1111 1111 12", "1 2 3",
    "+1 (132) 555-1352 +49.30.1234567 +1 2 +1(2) +12 345 678 901 234 567 8", "+1 (132) 555-1352 4111111111111111",
    "a@b.c" * 3, "..@.. a%@-.-", "mail bob (at) host (dot) com or 4111.1111.1111.1111",
]


def luhn(digits):
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def plain(text):
    """The base spans by the patterns as they stand."""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns(spark):
    df = documents(spark, list(enumerate(TEXTS))).selectExpr("*", "1 AS base", "2 AS spans")
    for r in pd_.personal_data(df).collect():
        base = [tuple(s) for s in r.base]
        assert base == plain(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        spans = [tuple(s) for s in r.spans]
        assert set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pd_.KINDS.index(s[0]), s[1], s[2]))


def test_reliabilities_are_estimated():
    """Two labelers that agree outweigh one that votes at random."""
    counts = []
    for true, n in ((True, 600), (False, 400)):
        for gazetteer in (1, -1):
            good = (1, 1) if true else (0, -1)
            counts.append(("email", (*good, gazetteer, 0, 0), n // 2))
    model = pd_.fit(counts)
    assert model.accuracy["checks"] > 0.95 and model.accuracy["gazetteer"] < 0.6
    assert ("email", (1, 1, 1, 0, 0)) in model.accepted
    assert ("email", (0, -1, 1, 0, 0)) not in model.accepted
    assert pd_.fit([]).accepted == frozenset()


def test_method_adds_supported_spans_only(spark):
    """Spelled-out addresses behind a cue are added once the votes on strict ones back them."""
    texts = [f"Please mail user{k}@site{k}.example.com today" for k in range(60)]
    texts += ["contact me, mail jane (at) site (dot) com", "version 1 (at) 2 (dot) 3", "nothing here"]
    out = {r.doc_id: r for r in pd_.personal_data(documents(spark, list(enumerate(texts)))).collect()}
    assert [s.kind for s in out[60].spans] == ["email"] and not out[60].base
    assert not out[61].spans and not out[62].spans
    assert all(len(out[k].spans) == 1 for k in range(60))


def test_repeats_null_ids_and_empty_table(spark):
    df = documents(spark, [(1, "a@b.cc"), (1, "a@b.cc"), (None, "a@b.cc")])
    assert rows(pd_.personal_data(df).selectExpr("doc_id", "size(spans) AS n"), "doc_id", "n") == sorted(
        [(1, 1), (1, 1), (None, 1)], key=repr
    )
    assert pd_.personal_data(df.limit(0)).count() == 0
