import pytest
from pyspark.sql import functions as F

from kithspark.functions import text
from kithspark.operators import views
from kithspark.operators.views import cheapest_split


def one(spark, column, *rows, schema="s string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_fold(spark):
    rows = ["Éàü ß", "CAFÉ", "é", None, ""]
    assert one(spark, text.fold(F.col("s")), *rows) == ["eau ß", "cafe", "e", None, ""]
    assert one(spark, text.fold(F.col("s"), exact=True), *rows, "ﬁn") == ["eau ß", "cafe", "e", None, "", "fin"]


@pytest.mark.parametrize(
    ("a", "b", "want"), [("kitten", "sitting", 200 * 4 / 13), ("", "", 100), ("a", "", 0), ("abc", "abc", 100), (None, "a", None)]
)
def test_indel(a, b, want):
    assert text.indel(a, b) == (None if want is None else pytest.approx(want))


def test_indel_brute_force():
    import itertools

    def lcs(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    words = ["".join(w) for n in range(5) for w in itertools.product("ab", repeat=n)]
    assert all(text._lcs(a, b) == lcs(a, b) for a in words for b in words)


def test_token_set():
    assert text.token_set("a b", "b a") == 100
    assert text.token_set("a b c", "a b") == 100
    assert text.token_set("", "a") == 0
    assert text.token_set("ab", "ac") == 50


def test_ratios_as_columns(spark):
    df = spark.createDataFrame([("kitten", "sitting"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(text.indel_ratio("a", "b")).collect()] == [pytest.approx(200 * 4 / 13), None]


def test_char_grams(spark):
    got = one(spark, text.char_grams(F.col("s"), 3, 5), "abcd", "ab", "aaaaaaa", "")
    assert [sorted(x) for x in got] == [["abc", "bcd"], [], ["aaa"], []]


def test_cheapest_split():
    known = {"pennington", "associates", "pen"}
    assert cheapest_split("penningtonassociates", known) == ["pennington", "associates"]
    assert cheapest_split("xyassociates", known) == ["xy", "associates"]
    assert cheapest_split("", known) == []
    assert cheapest_split("xyz", known) == ["xyz"]


def view(spark, version, *names, **options):
    df = spark.createDataFrame([(str(i), n, "US") for i, n in enumerate(names)], "id string, name string, country string")
    return {r["id"]: r for r in views.name_view(df, version, **options).collect()}


def test_names(spark):
    got = view(spark, "V4", "Société l.l.c. Foo", "X formerly known as Y Trading", "Acme (ID: 96415) #70318", "s.a.r.l. Dupont", "The Inc", 'A "quoted" name', "dba: Bar")
    assert got["0"]["nkey"] == "foo societe" and got["0"]["lt"] == ["llc"]
    assert got["1"]["nkey"] == "trading y"
    assert got["2"]["nkey"] == "acme"
    assert got["3"]["lt"] == ["sarl"] and got["3"]["nkey"] == "dupont"
    assert got["4"]["nt"] == [] and got["4"]["nkey"] == ""
    assert got["5"]["nkey"] == "a name quoted"
    assert got["6"]["nkey"] == "bar"


def test_domains(spark):
    vocab = spark.createDataFrame([("pennington",), ("associates",)], "word string")
    got = view(spark, "V2", "pennington-associates.com", "@penningtonassociates", "plain name", vocab=vocab)
    assert got["0"]["nkey"] == got["1"]["nkey"] == "associates pennington"
    assert got["2"]["nkey"] == "name plain"


def test_dictionary(spark):
    s1 = spark.createDataFrame([("S1-1", "Sharma Stores"), ("S1-2", "Sharma Foods")], "id string, name string")
    recs = spark.createDataFrame([("S2-1", "शर्मा स्टोर्स"), ("S2-2", "शर्मा Foods"), ("S2-3", "शर्मा")], "id string, name string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-2", "S2-3")], "s1_id string, rec_id string")
    got = dict(views.learn_dictionary(recs, s1, truth).collect())
    assert got == {"शर्मा": "sharma", "स्टोर्स": "stores"}
    left = views.learn_dictionary(recs, s1, truth, spark.createDataFrame([("S1-1",)], "s1_id string"))
    assert dict(left.collect()) == {"शर्मा": "sharma"}
    named = view(spark, "V3", "शर्मा foods", "Plain", dictionary=spark.createDataFrame(list(got.items()), "t string, t1 string"))
    assert named["0"]["nkey"] == "foods sharma" and named["1"]["nkey"] == "plain"


def addresses(spark, version, *rows):
    df = spark.createDataFrame([(str(i), a, c) for i, (a, c) in enumerate(rows)], "id string, addr string, country string")
    return {r["id"]: r for r in views.addr_view(df, version).collect()}


def test_addresses(spark):
    got = addresses(spark, "A2", ("02626 Belmont Ave, <null>", "US"), ("", "US"), ("null 7 x 7 12", "US"), ("99999999999999999999 1", "US"))
    assert got["0"]["nums"] == [2626] and got["0"]["house"] == "2626" and sorted(got["0"]["at"]) == ["02626", "ave", "belmont"]
    assert got["1"]["nums"] == [] and got["1"]["house"] is None and got["1"]["at"] == []
    assert got["2"]["nums"] == [7, 12]
    assert got["3"]["nums"] == [1]
    assert addresses(spark, "A1", ("No. 12b/3 Main", "US"))["0"]["house"] == "12b/3"


def test_expansion(spark):
    got = addresses(spark, "A3", ("1 st Ave West Virginia", "US"), ("Connecticut", "US"), ("st nazaire n 4, pas de calais", "France"), ("mh road", "India"), ("", "US"), ("new york ny", "US"))
    assert sorted(got["0"]["at"]) == ["1", "avenue", "street", "wv"]
    assert got["1"]["at"] == ["court"]  # the state's code is an abbreviation too
    assert sorted(got["2"]["at"]) == ["4", "de", "france", "hauts", "nazaire", "saint"]
    assert sorted(got["3"]["at"]) == ["maharashtra", "road"]
    assert got["4"]["at"] == []
    assert got["5"]["at"] == ["ny"]


def test_signature_and_components(spark):
    df = spark.createDataFrame([("1", "A b", "X"), ("2", "b a A", "X"), ("3", " ", "X")], "id string, addr string, country string")
    a, b, c = [r[0] for r in df.select(views.addr_signature(F.col("addr"))).collect()]
    assert a == b is not None and c is None
    got = views.components(spark.createDataFrame([("1", "X", "A, B c ,d")], "id string, country string, addr string")).collect()
    assert [(r["pos"], r["comp"]) for r in got] == [(0, "a"), (1, "b c"), (2, "d")]
