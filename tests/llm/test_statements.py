import itertools

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.llm import statements as S

BASE = (
    '<select id="find" resultType="long">SELECT a, b, c FROM t JOIN d ON x = y WHERE a = #{a} AND b &lt;= \'It\'\'s; -- x\' <if test="c != null"> AND c = #{c} </if> ORDER BY a DESC LIMIT 5</select>',
    "SELECT a, b, c FROM t JOIN d ON x = y WHERE a = #{a} AND b <= 'It''s; -- x' AND c = #{c} ORDER BY a DESC LIMIT 5",
)


def same(a, b):
    x, y = S.statement_fields(*a), S.statement_fields(*b)
    equal = sorted(x) == sorted(y)
    assert (S.fingerprint(x) == S.fingerprint(y)) == equal
    return equal


EQUAL = [
    ("<!-- note -->\n" + BASE[0].replace('id="find" resultType="long"', "resultType='long'\n id='find'"), BASE[1] + " ;;"),
    (BASE[0].replace("SELECT a, b, c FROM t", "select/* x */c ,`A`,\n\"b\" From [T]").replace("WHERE a = #{a} AND b", "where a=#{a} and B"), BASE[1].lower().replace("'it''s; -- x'", "'It''s; -- x'")),
    (BASE[0].replace("a = #{a} AND b &lt;= 'It''s; -- x'", "b <![CDATA[<=]]> 'It''s; -- x' AND a = #{ a }"), BASE[1]),
    (BASE[0].replace("</select>", "; -- done\n</select>"), BASE[1]),
]
OTHER = [
    (BASE[0].replace("a = #{a}", "a <> #{a}"), BASE[1]),
    (BASE[0].replace("#{a}", "${a}"), BASE[1]),
    (BASE[0].replace("#{a}", "#{A}"), BASE[1]),
    (BASE[0].replace("It''s", "it''s"), BASE[1]),
    (BASE[0].replace("LIMIT 5", "LIMIT 6"), BASE[1]),
    (BASE[0].replace("DESC", "ASC"), BASE[1]),
    (BASE[0].replace('"find"', '"Find"'), BASE[1]),
    (BASE[0].replace(' resultType="long"', ""), BASE[1]),
    (BASE[0].replace('test="c != null"', 'test="c != nil"'), BASE[1]),
    (BASE[0].replace("a, b, c", "a, b, c, c"), BASE[1]),
    (BASE[0].replace("a, b, c", "a, b"), BASE[1]),
    (BASE[0], BASE[1].replace("LIMIT 5", "LIMIT 6")),
    (BASE[0], None),
    (BASE[1], BASE[1]),
    (BASE[0].replace("x = y", "y = x"), BASE[1]),
    (BASE[0].replace("AND b", "OR b"), BASE[1]),
]


@pytest.mark.parametrize("other", EQUAL)
def test_layouts_are_equal(other):
    assert same(BASE, other)


@pytest.mark.parametrize("other", OTHER)
def test_all_else_counts(other):
    assert not same(BASE, other)


def test_listed_fields_move_with_what_belongs_to_them():
    assert same(plain("INSERT INTO t (a, b) VALUES (#{a}, f(1, 2))"), plain("insert into T(b,a) values(F(1,2),#{a});"))
    assert not same(plain("INSERT INTO t (a, b) VALUES (#{a}, #{b})"), plain("INSERT INTO t (a, b) VALUES (#{b}, #{a})"))
    assert same(plain("UPDATE t SET a = 1, b = #{b} WHERE x BETWEEN 1 AND 2 AND y = 3"), plain("UPDATE t SET b = #{b}, a = 1 WHERE y = 3 AND x BETWEEN 1 AND 2"))
    assert not same(plain("UPDATE t SET a = 1, b = 2"), plain("UPDATE t SET a = 2, b = 1"))
    assert not same(plain("UPDATE t SET a = 1 WHERE x BETWEEN 1 AND 2 AND y = 3"), plain("UPDATE t SET a = 1 WHERE x BETWEEN 1 AND 3 AND y = 2"))
    assert not same(plain("SELECT a FROM t WHERE a = 1 OR b = 2"), plain("SELECT a FROM t WHERE b = 2 OR a = 1"))
    assert not same(plain("SELECT a FROM t ORDER BY a, b"), plain("SELECT a FROM t ORDER BY b, a"))
    assert not same(plain("SELECT a FROM t WHERE b = 'a  b'"), plain("SELECT a FROM t WHERE b = 'a b'"))
    assert not same(plain("SELECT a FROM t WHERE b = ${Ab}"), plain("SELECT a FROM t WHERE b = ${aB}"))
    assert same(plain("SELECT a FROM t WHERE b>= ${ Ab }AND c<>'--'"), plain("SELECT a FROM t /* > */ WHERE c <> '--' AND b >= ${Ab} -- <>"))
    assert not same(plain("SELECT a FROM t WHERE b > = 1"), plain("SELECT a FROM t WHERE b >= 1"))
    assert same(plain("SELECT (a, b), c FROM t"), plain("SELECT c, (a , b) FROM t"))
    assert not same(plain("SELECT (a, b), c FROM t"), plain("SELECT c, (b, a) FROM t"))


def plain(text):
    return text, text


PAIRS = [
    # CASE ... END is one value in its own order
    ("SELECT a FROM t WHERE CASE WHEN p=1 AND q=2 THEN 1 END=1 AND r=3", "SELECT a FROM t WHERE CASE WHEN p=1 AND r=3 AND q=2 THEN 1 END=1", False),
    ("SELECT a FROM t WHERE CASE WHEN p=1 AND q=2 THEN 1 END=1 AND r=3", "SELECT a FROM t WHERE r=3 AND CASE WHEN p=1 AND q=2 THEN 1 END=1", True),
    ("SELECT CASE a WHEN 1 THEN 2 END, b FROM t", "SELECT b, CASE a WHEN 1 THEN 2 END FROM t", True),
    ("SELECT CASE a WHEN 1 THEN 2 END, b FROM t", "SELECT b, CASE a WHEN 2 THEN 1 END FROM t", False),
    ("SELECT case, a FROM t WHERE (case = 1)", "SELECT a, case FROM t WHERE (case = 1)", True),
    # subscripts are no quoted names
    ("SELECT a[1] FROM t", "SELECT a 1 FROM t", False),
    ("SELECT a [1] FROM t", "SELECT a[1] FROM t", True),
    ("SELECT a[1] FROM t", "SELECT a[2] FROM t", False),
    ("SELECT [a], b FROM [t]", "SELECT b, a FROM t", True),
    ("SELECT [dbo].[a] FROM [dbo].[t]", "SELECT dbo.a FROM dbo.t", True),
    ("SELECT f(x)[i] FROM t", "SELECT f(x) i FROM t", False),
    # selects and conditions in brackets
    ("SELECT a FROM t WHERE b IN (SELECT c, d FROM u WHERE e = 1 AND f = 2)", "SELECT a FROM t WHERE b IN (select d, c from u where f = 2 and e = 1)", True),
    ("SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE e = 1 AND f = 2)", "SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE e = 2 AND f = 1)", False),
    ("SELECT a FROM t WHERE (x = 1 AND y = 2) OR z = 3", "SELECT a FROM t WHERE (y = 2 AND x = 1) OR z = 3", True),
    ("SELECT a FROM t WHERE (x = 1 OR y = 2) AND z = 3", "SELECT a FROM t WHERE z = 3 AND (y = 2 OR x = 1)", False),
    ("SELECT a FROM t WHERE (x BETWEEN 1 AND 2 AND y = 3)", "SELECT a FROM t WHERE (y = 3 AND x BETWEEN 1 AND 2)", True),
    ("SELECT a FROM t WHERE (x BETWEEN 1 AND 2 AND y = 3)", "SELECT a FROM t WHERE (x BETWEEN 1 AND 3 AND y = 2)", False),
    ("SELECT a FROM t JOIN u ON (x = 1 AND y = 2)", "SELECT a FROM t JOIN u ON (y = 2 AND x = 1)", False),
    ("SELECT a, f(b, c) FROM t", "SELECT a, f(c, b) FROM t", False),
    ("SELECT a FROM (SELECT b, c FROM t) x", "SELECT a FROM (SELECT c, b FROM t) x", True),
    # what follows inserted rows, or stands before selected columns, counts
    ("INSERT INTO t (a) VALUES (1)", "INSERT INTO t (a) VALUES (1) ON CONFLICT DO NOTHING", False),
    ("INSERT INTO t (a) VALUES (1), (2)", "INSERT INTO t (a) VALUES (2), (1)", False),
    ("INSERT INTO t (a, b) SELECT DISTINCT c, d FROM u", "INSERT INTO t (b, a) SELECT DISTINCT d, c FROM u", True),
    ("INSERT INTO t (a, b) SELECT DISTINCT c, d FROM u", "INSERT INTO t (a, b) SELECT c, d FROM u", False),
    ("SELECT TOP 5 a, b FROM t", "SELECT TOP 5 b, a FROM t", True),
    ("SELECT TOP 5 a, b FROM t", "SELECT TOP 6 a, b FROM t", False),
    ("SELECT DISTINCT ON (a) a, b FROM t", "SELECT DISTINCT ON (b) a, b FROM t", False),
]


@pytest.mark.parametrize(("a", "b", "equal"), PAIRS)
def test_brackets_and_cases(a, b, equal):
    assert same(plain(a), plain(b)) is equal


@given(st.lists(st.sampled_from(["(", ")", "case", "end", "a", "b", "and", "or", ",", "select", "where", "between", "[", "]", "1", "<if test='x'>", "</if>"]), max_size=24), st.randoms())
@settings(max_examples=400, deadline=None)
def test_any_row_of_tokens_is_read_and_swaps_count_in_cases(words, rng):
    inside = [w for w in words if w not in ("(", ")", "case", "end", "[", "]") and "<" not in w]
    other = inside[:]
    rng.shuffle(other)
    assert S.statement_fields(" ".join(["select", *words]), None)
    a, b = (f"select x from t where y = case when {' '.join(w)} then 1 end" for w in (inside, other))
    assert same(plain(a), plain(b)) is (inside == other)
    a, b = (f"select x from t where y = f[ {' '.join(w)} ]" for w in (inside, other))
    assert same(plain(a), plain(b)) or inside != other


def test_deep_brackets():
    deep = "(" * 50_000 + "a" + ")" * 50_000
    assert same(plain(f"SELECT x, {deep} FROM t"), plain(f"SELECT {deep}, x FROM t"))
    assert not same(plain(f"SELECT {deep} FROM t"), plain(f"SELECT {deep.replace('a', 'b')} FROM t"))
    assert S.statement_fields("select " + "( case " * 50_000, None) and S.statement_fields("select (" + "case " * 50_000 + ")", None)


@pytest.mark.parametrize("text", [None, "", "  ", " ", "-- x", "/* x */ ;"])
def test_no_content_is_no_statement(text):
    assert S.statement_fields(text, "select 1") is None


def test_unreadable_markup_and_long_texts_do_not_fail():
    assert S.statement_fields("<select id='x'>select a < b", "x")
    assert S.statement_fields("<", None) and S.statement_fields("'open", "''") and S.statement_fields("#{open", "(((")
    many = "SELECT " + ", ".join(f"c{i}" for i in range(20_000)) + " FROM t"
    back = "SELECT " + ", ".join(f"c{i}" for i in reversed(range(20_000))) + " FROM t"
    assert same((many, many), (back, back))


def grouped(spark, data, bits=128):
    df = spark.createDataFrame(data, "id bigint, t string, n string, fp string, keep_id string")
    return sorted(map(tuple, S.statement_classes(df, F.col("id"), F.col("t"), F.col("n"), bits).collect()))


@pytest.mark.parametrize("bits", [128, 3, 0])
def test_classes_even_if_fingerprints_collide(spark, bits):
    texts = [f"SELECT {', '.join(p)} FROM t{k}" for k in range(6) for p in itertools.permutations("abc")]
    data = [(i + 1, t, t, "x", "y") for i, t in enumerate(texts)]
    data += [(100, None, "x", "x", "y"), (101, "", "x", "x", "y"), (None, "select 1", "x", "x", "y"), (1, texts[0], texts[0], "x", "y")]
    data += [(200 + i, "select hot", None, "x", "y") for i in range(40)]
    expect = [(i + 1, i // 6 * 6 + 1) for i in range(36)] + [(200 + i, 200) for i in range(40)]
    assert grouped(spark, data, bits) == sorted(expect)


def test_empty_table(spark):
    assert grouped(spark, []) == []
