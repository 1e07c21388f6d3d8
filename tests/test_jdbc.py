"""The JDBC source on a database in memory: keys, column metadata, reads and pushed filters."""

import pytest

from heddle.plans.catalog import load
from heddle.plans.executor import Executor
from heddle.plans.policy import Identity, resolve
from heddle.plans.reader import Reader
from heddle.sources.parquet import jdbc_declaration, jdbc_tables

URL = "jdbc:derby:memory:shelves"
STATEMENTS = (
    "CREATE TABLE ROOMS (FLOOR INT NOT NULL, NR INT NOT NULL, TITLE VARCHAR(40), PRIMARY KEY (FLOOR, NR))",
    """CREATE TABLE SHELVES (ID BIGINT NOT NULL GENERATED ALWAYS AS IDENTITY PRIMARY KEY, FLOOR INT, ROOM INT, WIDTH DECIMAL(6,2), KIND VARCHAR(10) DEFAULT 'open',
       AREA GENERATED ALWAYS AS (WIDTH * 2), CONSTRAINT STANDS_IN FOREIGN KEY (FLOOR, ROOM) REFERENCES ROOMS (FLOOR, NR))""",
    "INSERT INTO ROOMS VALUES (1, 1, 'maps'), (1, 2, 'atlases'), (2, 1, NULL)",
    "INSERT INTO SHELVES (FLOOR, ROOM, WIDTH) VALUES (1, 1, 1.50), (1, 1, 2.25), (2, 1, 0.75), (NULL, NULL, 3.00)",
)


@pytest.fixture(scope="module")
def reader(spark):
    connection = spark._jvm.java.sql.DriverManager.getConnection(f"{URL};create=true")
    statement = connection.createStatement()
    for text in STATEMENTS:
        statement.execute(text)
    connection.close()
    names = ["ROOMS", "SHELVES"]
    tables = jdbc_tables(spark, URL)
    catalog = load(jdbc_declaration(spark, URL, names), {n: tables(n).schema for n in names})
    return Reader(spark, catalog, resolve("r", {"tables": {"*": {"select": True}}}, catalog), Identity("r", {}), tables)


def test_declaration(reader):
    rooms, shelves = reader.catalog["ROOMS"], reader.catalog["SHELVES"]
    assert rooms.primary_key == ("FLOOR", "NR") and shelves.primary_key == ("ID",)
    (key,) = shelves.foreign_keys
    assert (key.name, key.columns, key.ref_table, key.ref_columns) == ("STANDS_IN", ("FLOOR", "ROOM"), "ROOMS", ("FLOOR", "NR"))
    assert shelves.columns["ID"].auto_increment and shelves.columns["AREA"].generated and shelves.columns["KIND"].has_default
    assert not rooms.columns["TITLE"].has_default


def test_reads(reader):
    fields = {t: {c.name: f for f, c in reader.fields(t).items()} for t in ("ROOMS", "SHELVES")}
    room, many = (next(r.name for r in reader.catalog.relations(t).values()) for t in ("SHELVES", "ROOMS"))
    s, r = (reader.catalog[t].field for t in ("SHELVES", "ROOMS"))
    text = f"{{ {s}_connection(where: {{{fields['SHELVES']['WIDTH']}: {{_gt: 1}}}}) {{ nodes {{ w: {fields['SHELVES']['WIDTH']} room: {room} {{ t: {fields['ROOMS']['TITLE']} }} }} total_count }} {r}_connection {{ nodes {{ all: {many} {{ w: {fields['SHELVES']['WIDTH']} }} }} }} }}"
    found = Executor(reader).execute(text)
    assert "errors" not in found, found
    assert found["data"][f"{s}_connection"] == {"nodes": [{"w": "1.50", "room": {"t": "maps"}}, {"w": "2.25", "room": {"t": "maps"}}, {"w": "3.00", "room": None}], "total_count": 3}
    assert [[x["w"] for x in n["all"]] for n in found["data"][f"{r}_connection"]["nodes"]] == [["1.50", "2.25"], [], ["0.75"]]


def test_filters_reach_the_database(reader):
    df = reader.rows("SHELVES", {reader.catalog["SHELVES"].columns["ID"].field: {"_gt": 2}})
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,2)]" in df._jdf.queryExecution().toString()
