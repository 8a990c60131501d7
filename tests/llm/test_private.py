import re

from quadtide.llm import pii, secrets

TEXTS = [
    "a@b.c_d@e.f.g x@y aaaa@ .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 00.0.0.255 1.2.3", "4111 1111-1111 1111 4111111111111112 1234567890123456789012345",
    "+1 (947) 555-7668 +12 +1-2-3-4-5-6-7-8-9-0 +1+2+3", "\U0001F600 ann@mail.org \U0001F600 10.0.0.1", "x" * 50_000, "1 " * 20_000, "", "@" * 1000, "4 0 4 1 8 9 4 9 7 4 6 0 8 7 9 5",
]
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "card":
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1]))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "phone": 9 <= len(d) <= 15}[kind]


def plain(text):
    found = [(m.start(), n, m.end()) for n, k in enumerate(pii.KINDS) for m in re.finditer(BASE[k], text or "") if ok(k, m[0])]
    return sorted(found)


def test_patterns_equal_their_plain_forms(spark):
    texts = [t for t in TEXTS if len(t) < 40_000]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.id: [(s.start, s.kind, s.end) for s in r.base] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_long_runs_are_read_once(spark):
    got = pii.find(spark.createDataFrame([(0, TEXTS[5] * 10), (1, "7" * 100_000), (2, "a." * 50_000 + "@")], "doc_id long, text string")).collect()
    assert all(not r.base for r in got)


def test_terms_that_give_an_entity_away(spark):
    docs = [(i, f"common words all around {i} here zorvaxian owner ann@mail.org writes again {i}") for i in range(3)]
    docs += [(i, f"common words all around {i} here and the owner writes again {i}") for i in range(3, 60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: {docs[r.id][1][t.start : t.end] for t in r.terms} for r in pii.find(frame).collect()}
    assert got[0] == got[1] == got[2] == {"zorvaxian"} and not any(got[i] for i in range(3, 60))
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert clean[0] == "common words all around 0 here  owner <EMAIL> writes again 0" and clean[5] == docs[5][1]


def test_terms_far_from_the_mention_and_in_other_documents(spark):
    far = " ".join(["common words all around"] * 40)
    docs = [(i, f"Zorvaxian starts, {far} and ann@mail.org ends {i} before zorvaxian") for i in range(3)]
    # One address in a single document, its term in another one too; one term stands without the entity.
    docs += [(3, f"quibblet {far} bob@mail.org"), (4, f"{far} Quibblet"), (5, f"no address: {far} zorvaxian")]
    docs += [(i, f"{far} and so on, owner {i} ends starts before address") for i in range(6, 200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: [docs[r.id][1][t.start : t.end] for t in r.terms] for r in pii.find(frame).collect()}
    assert all(got[i] == ["Zorvaxian", "zorvaxian"] for i in range(3)) and got[5] == ["zorvaxian"]
    assert got[3] == ["quibblet"] and got[4] == ["Quibblet"] and not any(got[i] for i in range(6, 200))
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert clean[0] == f"<TERM> starts, {far} and <EMAIL> ends 0 before <TERM>" and clean[4] == f"{far} <TERM>" and clean[5] == f"no address: {far} <TERM>"
    assert clean[7] == docs[7][1]


def test_personal_data_of_odd_rows(odd, none):
    got = pii.find(odd).collect()
    assert len(got) == 13 and sum(len(r.base) for r in got) == 2
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and out.count() == 13
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[10].text == "mail me at <EMAIL> or <PHONE>" and rows[4].text is None and rows[10].id == 99
    assert pii.find(none).count() == 0 and pii.sanitise(none).count() == 0


def test_secrets_by_pattern_and_token_efficiency(spark, odd, none):
    texts = [
        "password=secret : longvalue123456", "API_KEY = 'abcdefghijkl'", "AKIA" + "A" * 14 + " AKIA" + "A" * 13, "0123456789abcdef 0123456789abcde",
        "key x9Kq2LmP0zRt7VbN4cWd end", "id 123e4567-e89b-12d3-a456-426614174000 internationalization2024release", None, "",
    ]
    got = {r.id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == [] and got[1] == [("assign", 0, 23)] and got[2] == [("access", 0, 18)] and got[3] == [("hex", 0, 16)]
    assert got[4] == [("token", 4, 24)] and got[5] == [] and got[6] == got[7] == []
    assert secrets.redact(texts[4], [{"start": 4, "end": 24}]) == "key <SECRET> end"
    assert secrets.scan(odd).count() == 13 and secrets.scan(none).count() == 0
    assert secrets.without_secrets(odd).columns == odd.columns
    clean = secrets.without_secrets(spark.createDataFrame([(1, texts[1]), (2, None)], "doc_id long, text string")).collect()
    assert [r.text for r in clean] == ["<SECRET>'", None]


def test_secrets_with_few_digits_or_none():
    encode = secrets.encoder(secrets.public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary
    found = lambda text: secrets.spans_of(text, encode, secrets.TokenTest())
    assert found("key xQkJzVbWqPfGhTyRmNcLdKsX end") == [("token", 4, 28)] and found("key xKqVLmPzR7tVbNcWdQjH end") == [("token", 4, 24)]
    assert found("see internationalization-and-localization or /usr/share/common/licenses") == []
