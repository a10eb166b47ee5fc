import datetime
import re

from buyerlens.llm.pii import PATTERN, pseudonymize


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)]
    return sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    return {r["doc_id"]: r for r in pseudonymize(df, key).collect()}


def test_values_change_inside_their_format(spark):
    values = ["4111111111111111", "9807915762804490", "4111 1111 1111 1111", "378282246310005", "+1 (017) 555-7713",
              "97.51.17.173", "und.34@mail7.example.com", "UND.34@MAIL7.EXAMPLE.COM", "DE89370400440532013000", "2024-02-29",
              "31.12.1999", "28/02/1950", "078-05-1120", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce",
              "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "a@b.c"]
    out = run(spark, [f"{v}" for v in values] + [f"x {v}, again ({v}).\n{v}" for v in values])
    for i, v in enumerate(values):
        new = out[i]["text"]
        assert new != v and len(out[i]["found"]) == 1
        if "ipv4" != out[i]["found"][0]["kind"]:
            shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
            assert "secret" == out[i]["found"][0]["kind"] or shape(new) == shape(v)
        # the same value has the same pseudonym in every place
        assert out[len(values) + i]["text"] == f"x {new}, again ({new}).\n{new}"
        assert out[len(values) + i]["n_found"] == 3
    assert luhn(out[0]["text"]) % 10 == 0 and luhn(out[3]["text"]) % 10 == 0
    assert luhn(out[1]["text"]) % 10 == luhn(values[1]) % 10
    assert out[2]["text"].replace(" ", "") == out[0]["text"]
    assert all(0 <= int(o) <= 255 for o in out[5]["text"].split("."))
    assert mod97(out[8]["text"]) == 1
    datetime.date.fromisoformat(out[9]["text"])
    datetime.datetime.strptime(out[10]["text"], "%d.%m.%Y")
    datetime.datetime.strptime(out[11]["text"], "%d/%m/%Y")
    assert out[6]["text"].endswith("@mail7.example.com")
    assert run(spark, [values[0]], key="other")[0]["text"] != out[0]["text"]


def digits(s):
    return re.sub("[^0-9]", "", s)


def test_one_number_in_many_forms_has_one_pseudonym(spark):
    groups = [
        ["+491701234567", "+49 170 1234567", "+49 (170) 123 4567", "+49-170-1234567"],
        ["+12665557228", "+1 (266) 555-7228", "+1 266 555 7228", "(266) 555-7228", "(266)555-7228", "266-555-7228",
         "266.555.7228", "1-266-555-7228", "1 (266) 555-7228"],
        ["+1 (017) 555-7713", "(017) 555-7713", "017-555-7713"],
        ["+3584012345678", "+358 40 1234 5678"],
        ["020 7946 0958", "0207 9460958", "020-7946-0958"],
        ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"],
        ["NO9386011117947", "NO93 8601 1117 947"],
        ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"],
    ]
    out = run(spark, [f"call {v}, THEN 12 more" for g in groups for v in g])
    at = 0
    for g in groups:
        plain = set()
        for v in g:
            new = out[at]["text"][len("call "):-len(", THEN 12 more")]
            assert out[at]["n_found"] == 1 and new != v, v
            assert re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", v)
            plain.add(new.replace(" ", "") if v[0].isalpha() else digits(new)[-10:])
            at += 1
        assert len(plain) == 1, (g, plain)
        if g[0][0].isalpha():
            assert mod97(plain.pop()) == 1
        elif g[0].startswith("+"):
            country = {"+49": "49", "+12": "1", "+1 ": "1", "+35": "358"}[g[0][:3]]
            assert digits(out[at - len(g)]["text"]).startswith(country)


def test_a_grouped_iban_ends_with_its_country_length(spark):
    out = run(spark, ["DE89 3704 0044 0532 0130 00 1234 AND MORE", "DE88 3704 0044 0532 0130 00", "12-266-555-7228", "266-555-72281",
                      "version 10.266.555"])
    assert out[0]["found"][0]["kind"] == "iban" and out[0]["text"].endswith(" 1234 AND MORE")
    assert [out[i]["n_found"] for i in (1, 2, 3, 4)] == [0, 0, 0, 0]


def test_what_is_not_valid_stays(spark):
    texts = [None, "", "no digits", "300.1.1.1", "2023-02-29", "31.13.1999", "version 4.0.", "year 2024, 12 items", "1234567890123456789012",
             "DE00370400440532013000 is no IBAN", "x" * 300_000, "@@@", "1850-01-01"]
    out = run(spark, texts)
    assert [out[i]["text"] for i in range(len(texts))] == texts
    assert all(out[i]["n_found"] == 0 for i in range(len(texts)))


def test_permutations_are_one_to_one(spark):
    octets = [f"10.0.{i // 250}.{i % 250}" for i in range(1000)]
    days = [(datetime.date(1990, 1, 1) + datetime.timedelta(days=i)).isoformat() for i in range(1000)]
    phones = [f"+49 {i:03d} 12 34" for i in range(1000)]
    mails = [f"{c}{i}@x.org" for c in "ab" for i in range(500)]
    out = run(spark, [" ".join(v) for v in (octets, days, phones, mails)])
    for i in range(4):
        values = [f["value"] for f in out[i]["found"]]
        assert len(values) == 1000 and len(set(values)) == 1000


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "4111111111111111")] * 3 + [(None, "4111111111111111")], "doc_id long, text string")
    assert len({r["text"] for r in pseudonymize(df, "k").collect()}) == 1
    assert pseudonymize(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def test_whole_documents_match_python(spark, sf001):
    """Everything outside the matches stays; every match of the pattern is replaced in place."""
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text")
    old = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pseudonymize(docs, "k").collect():
        parts = re.split(PATTERN, old[r["doc_id"]])
        new = r["text"]
        at = 0
        for p in parts:
            at = new.index(p, at) + len(p)
        for kind in (r"[0-9]{16}", r"[a-z]+\.[0-9]+@", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"):
            assert not set(re.findall(kind, old[r["doc_id"]])) & set(re.findall(kind, new))
