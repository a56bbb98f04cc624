from decimal import Decimal

import pytest

from evenkeel.functions.assign import long_name, storage_type
from evenkeel.operators.conform import conform, conform_kept, conform_rejects, duplicate_keys, null_keys
from evenkeel.operators.spec import Column, TableContract


def contract(**types):
    return TableContract("t", tuple(Column(n, t) for n, t in types.items()), (next(iter(types)),))


def one(spark, value_sql, type_):
    df = spark.sql(f"SELECT 1 AS k, {value_sql} AS v")
    return conform(df, contract(k="int", v=type_)).first().v


@pytest.mark.parametrize(
    "value,type_,expected",
    [
        ("'abc  '", "varchar(3)", "abc"),
        ("'ab'", "varchar(3)", "ab"),
        ("'a'", "char(3)", "a  "),
        ("'a    '", "char(3)", "a  "),
        ("'101'", "bit(3)", "101"),
        ("1.234", "decimal(10,2)", Decimal("1.23")),
        ("'1.235'", "decimal(10,2)", Decimal("1.24")),
        ("'-1.235'", "decimal(10,2)", Decimal("-1.24")),
        ("2", "decimal(10,2)", Decimal("2.00")),
        ("2.5D", "int", 2),
        ("3.5D", "int", 4),
        ("2.5", "int", 3),
        ("-2.5", "int", -3),
        ("' 12 '", "int", 12),
        ("'on'", "boolean", True),
        ("'no'", "boolean", False),
        ("'2024-02-29'", "date", None),
        ("NULL", "varchar(3)", None),
        ("NULL", "int", None),
        ("array('abc ', 'x')", "varchar(3)[]", ["abc", "x"]),
    ],
)
def test_assignment(spark, value, type_, expected):
    got = one(spark, value, type_)
    if type_ == "date":
        assert got.isoformat() == "2024-02-29"
    else:
        assert got == expected


@pytest.mark.parametrize(
    "value,type_,message",
    [
        ("'abcd'", "varchar(3)", "value too long for type character varying(3)"),
        ("'USA'", "char(2)", "value too long for type character(2)"),
        ("'abc'", "int", "invalid input syntax for type integer"),
        ("'1.5'", "int", "invalid input syntax for type integer"),
        ("3000000000", "int", "invalid input syntax for type integer"),
        ("'12'", "bit(3)", "invalid input syntax for type bit(3)"),
        ("12345.6", "decimal(5,1)", None),
        ("123456", "decimal(5,1)", "invalid input syntax for type numeric(5,1)"),
        ("'{\"a\":'", "json", "invalid input syntax for type json"),
        ("'2023-02-29'", "date", "invalid input syntax for type date"),
        ("array('abcd')", "varchar(3)[]", "value too long for type character varying(3)[]"),
    ],
)
def test_refused_and_never_silently_null(spark, value, type_, message):
    df = spark.sql(f"SELECT 1 AS k, {value} AS v")
    table = contract(k="int", v=type_)
    if message is None:
        message = "invalid input syntax for type numeric(5,1)"
    with pytest.raises(Exception, match="value too long|invalid input") as e:
        conform(df, table).collect()
    assert message in str(e.value)
    [reject] = conform_rejects(df, table, ["k"]).collect()
    assert (reject.k, reject.column_name, reject.reason) == (1, "v", message)
    assert conform_kept(df, table).isEmpty()


def test_one_reject_per_bad_value(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'abcd', 'x'), (2, 'ab', '7'), (3, NULL, 'y') AS t(k, name, n)")
    table = contract(k="int", name="varchar(3)", n="int")
    got = sorted((r.k, r.column_name) for r in conform_rejects(df, table, ["k"]).collect())
    assert got == [(1, "n"), (1, "name"), (3, "n")]
    assert [r.k for r in conform_kept(df, table).collect()] == [2]


def test_key_checks(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a'), (1, 'a'), (NULL, 'b'), (2, NULL), (3, 'c') AS t(a, b)")
    assert null_keys(df, ["a", "b"]).count() == 2
    many = spark.range(20).selectExpr("id % 8 AS a", "'x' AS b")
    assert [tuple(r) for r in duplicate_keys(many, ["a", "b"]).collect()] == [(i, "x") for i in range(5)]


def test_type_names():
    assert storage_type("varchar(3)") == "string"
    assert storage_type("numeric(10,2)") == "decimal(10,2)"
    assert storage_type("json[]") == "array<string>"
    assert storage_type("bigint") == "bigint"
    assert long_name("decimal(10,2)") == "numeric(10,2)"


def test_types_by_their_other_names(spark):
    from evenkeel.functions.assign import storage_type

    names = {
        "jsonb": "string", "timestamptz": "timestamp", "double precision": "double", "uuid": "string", "bytea": "binary",
        "int8": "bigint", "bigserial": "bigint", "character varying(9)": "string", "numeric": "decimal(38,10)",
        "character varying(9)[]": "array<string>", "real": "float", "int2": "smallint", "numeric(8,1)": "decimal(8,1)",
    }
    assert {n: storage_type(n) for n in names} == names
    with pytest.raises(ValueError, match="hstore"):
        storage_type("hstore")


def test_an_unsized_numeric_cuts_no_digits(spark):
    contract = TableContract("t", (Column("n", "numeric"),), ("n",))
    for good in ("'1.5'", "'0.0000000001'", "CAST(2 AS DECIMAL(20,15))", "CAST(0.25 AS DOUBLE)", "'12345678901234567890.5'"):
        assert len(conform(spark.sql(f"SELECT {good} AS n"), contract).collect()) == 1
    for bad in ("'0.000000000001'", "'1e-12'", "CAST('0.123456789012' AS DECIMAL(20,12))", "CAST(1e-12 AS DOUBLE)", "'1.12345678901'"):
        with pytest.raises(Exception, match="invalid input"):
            conform(spark.sql(f"SELECT {bad} AS n"), contract).collect()


def test_uuids_compare_by_value(spark):
    contract = TableContract("t", (Column("u", "uuid"),), ("u",))
    rows = spark.sql("SELECT 'A0EEBC999C0B4EF8BB6D6BB9BD380A11' AS u")
    assert conform(rows, contract).first().u == "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"
    with pytest.raises(Exception, match="uuid"):
        conform(spark.sql("SELECT 'no' AS u"), contract).collect()
