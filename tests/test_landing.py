import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk import params as P
from tamarisk.functions import text as X
from tamarisk.operators import classify, profile as prof, roles, rules
from tamarisk.plans import lakehouse, medallion
from tamarisk.session import scratch_path
from tamarisk.sources import code_lists, text_tables as tt, zones


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def sales(rows, null_at):
    """A small sales file: ``null_at`` rows without quantity, the last row repeated."""
    body = [f"2026-01-{i + 1:02d},item{i},cat{i % 3},{'' if i < null_at else i + 1},{9.5 + i},north" for i in range(rows)]
    return ["date,product,category,quantity,unit_price,region", *body, body[-1]]


def test_heavy_nulls_hold_at_silver_then_promote(spark, tmp_path):
    raw = tt.read_raw(spark, write(tmp_path, "sales.csv", sales(21, 5)))
    root = scratch_path(spark, "t")
    landed = medallion.run_upload(raw, root, "sales", "20260101T000000", as_text=True)
    assert dict(spark.read.parquet(landed.bronze_path).dtypes)["quantity"] == "string" and dict(spark.read.parquet(landed.silver_path).dtypes)["quantity"] == "bigint"
    reg = landed.registry.first()
    assert (reg["rows"], reg["duplicate_rows_removed"], reg["stage"], landed.gold_path) == (21, 1, "silver_held", None)
    assert reg["null_counts"] == {"quantity": 5} and reg["hold_reason"] == "a column is 24% null, over the 10% auto-promotion threshold"
    promoted = medallion.promote(spark, landed.registry, "sales", root, "20260102T000000").first()
    assert (promoted["stage"], promoted["message"]) == ("gold", "promoted") and spark.read.parquet(promoted["gold_path"]).count() == 21
    with pytest.raises(ValueError, match="no dataset"):
        medallion.promote(spark, landed.registry, "other", root, "v")


def test_clean_file_reaches_gold_without_its_empty_column(spark, tmp_path):
    lines = ["id,product,quantity,unit_price,mostly_empty"] + [f"{i},p{i % 4},{i * 2},{'' if i == 3 else i + 0.5},{'x' if i < 3 else ''}" for i in range(30)]
    landed = medallion.run_upload(tt.read_table(spark, write(tmp_path, "clean.csv", lines)), scratch_path(spark, "t"), "clean", "20260101T000000")
    reg = landed.registry.first()
    assert reg["stage"] == "gold" and reg["dropped_columns"] == ["mostly_empty"]
    gold = spark.read.parquet(landed.gold_path)
    assert set(gold.columns) == {"id", "product", "quantity", "unit_price"}
    assert {r["column_name"]: r["sum"] for r in prof.numeric_summary(gold).collect()} == {"quantity": 870.0, "unit_price": 446.5}
    top = prof.top_categories(gold).collect()
    assert [(r["value"], r["n"]) for r in sorted(top, key=lambda r: r["rank"])] == [("p0", 8), ("p1", 8), ("p2", 7), ("p3", 7)]


@pytest.mark.parametrize("nulls,stage", [(1, "gold"), (3, "silver_held")])
def test_small_tables_have_their_own_threshold(spark, nulls, stage):
    df = spark.range(7).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("kind"), F.when(F.col("id") >= nulls, F.col("id") * 0.1).alias("rate"), F.col("id").alias("_row_pos"))
    got = prof.gate(prof.column_profile(prof.to_silver(df), "rates")).first()
    assert got["stage"] == stage
    assert (got["hold_reason"] or "").endswith("(small-table threshold, 7 rows)") == (stage == "silver_held")


def test_empty_and_malformed_files_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="contains no rows"):
        tt.read_raw(spark, write(tmp_path, "empty.csv", ["a,b"]))
    with pytest.raises(Exception, match="(?i)malformed"):
        tt.read_raw(spark, write(tmp_path, "bad.csv", ["a,b", "1,2,3"])).collect()


def test_positions_follow_the_file_over_many_splits(spark, tmp_path):
    path = write(tmp_path, "many.csv", ["n,text"] + [f"{i},{'x' * (i % 50)}" for i in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        raw = tt.read_raw(spark, path)
        assert raw.select(F.count_if(F.col("n").cast("long") != F.col("_row_pos"))).first()[0] == 0 and raw.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_cells(spark, tmp_path):
    path = write(tmp_path, "q.csv", ["id,text", '1,"a, b"', '2,"say ""hi"""', '3,"two', 'lines"'])
    got = {r["id"]: (r["text"], r["_row_pos"]) for r in tt.read_raw(spark, path).collect()}
    assert got == {"1": ("a, b", 0), "2": ('say "hi"', 1), "3": ("two\nlines", 2)}


def odd_cells(rng):
    plain = ["", "a", "é", " x", "b c", "a\\", "it''s"]
    quoted = ['"a, b"', '"say ""hi"""', '"two\nlines"', '"""\n"""', '","', '"\n\n"', '""', '"\r\n,\n"', '"tail"x', '"#"']
    return rng.choice(quoted if rng.random() < 0.4 else plain)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_over_many_splits(spark, tmp_path, end):
    """The same rows as by a reader that takes a file whole, in file order, whatever the splits."""
    import random

    rng = random.Random(len(end))
    for f in range(3):
        rows = ["n,one,two", *[f"{f}-{k},{odd_cells(rng)},{odd_cells(rng)}" for k in range(400)]]
        (tmp_path / f"part-{f}.csv").write_bytes((end.join(rows) + (end if f else "")).encode())
    (tmp_path / "part-1a.csv").write_bytes(b"")
    path = str(tmp_path)
    whole = spark.read.options(header=True, multiLine=True, escape='"', mode="FAILFAST").csv(path)
    want = {r.n: (r.one, r.two) for r in whole.collect()}
    assert len(want) == 1200
    for size in ("400b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            raw = tt.read_raw(spark, path)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        got = raw.orderBy("_row_pos").collect()
        plain = lambda cells: tuple(c and c.replace("\r\n", "\n") for c in cells)  # the other reader rewrites the file's own line end in cells
        assert {r.n: plain((r.one, r.two)) for r in got} == {n: plain(cells) for n, cells in want.items()}
        assert end == "\r\n" or {r.n: (r.one, r.two) for r in got} == want
        assert [(r.n, r["_row_pos"]) for r in got] == [(f"{k // 400}-{k % 400}", k) for k in range(1200)]


def test_positions_do_not_depend_on_later_planning(spark, tmp_path):
    path = write(tmp_path, "many.csv", ["n,text"] + [f"{i},{'x' * (i % 50)}" for i in range(20000)])
    scan = spark.read.option("header", True).csv(path)
    for change in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes"):
        spark.conf.set(change, "24" if change.endswith("Parallelism") else "30k")
        made = [tt.read_raw(spark, path), tt.with_row_positions(scan)]
        spark.conf.unset(change)
        for df in made:
            assert df.select(F.count_if(F.col("n").cast("long") == F.col("_row_pos"))).first()[0] == df.count() == 20000


def test_a_quote_left_open_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)malformed"):
        tt.read_raw(spark, write(tmp_path, "open.csv", ["a,b", '1,"x', "2,y"]))


def test_null_tokens_and_types(spark, tmp_path):
    lines = ["a,b,c,d,e", "1,1.5,True,x,NA", "NA,null,False,NaN,", "3,2,True,None,n/a"]
    df = tt.read_table(spark, write(tmp_path, "t.csv", lines))
    assert [t for c, t in df.dtypes if c != "_row_pos"] == ["bigint", "double", "boolean", "string", "string"]
    assert [r["a"] for r in df.orderBy("_row_pos").collect()] == [1, None, 3] and df.where("e IS NOT NULL").count() == 0


def test_union_of_parts(spark):
    out = tt.union_parts(spark.sql("SELECT 1 AS id, 'a' AS x"), spark.sql("SELECT 'b7' AS id, 2.5D AS y"))
    assert {(r["id"], r["x"], r["y"]) for r in out.collect()} == {("1", "a", None), ("b7", None, 2.5)}


def cells(spark):
    return spark.sql("""SELECT * FROM VALUES
        ('a', 0, array('Customer master report', NULL, NULL)), ('a', 1, array('Generated for review', NULL, NULL)), ('a', 2, array('customer_id', 'name', 'branch')),
        ('a', 3, array('C1', 'Alice', 'Riyadh')), ('a', 4, array(NULL, NULL, NULL)), ('a', 5, array('C2', 'Bob', 'Jeddah')), ('a', 6, array('C3', NULL, 'Dammam')),
        ('b', 0, array('id', 'value', 'note')), ('b', 1, array('1', '10', NULL)), ('c', 0, array('', NULL, ' ')) AS t(file, row_pos, cells)""")


def test_header_detection(spark):
    heads = tt.header_rows(cells(spark))
    assert {r["file"]: (r["header_row"], r["unnamed"]) for r in heads.collect()} == {"a": (2, 0), "b": (0, 0)}
    body = tt.body_cells(cells(spark), heads).where("file = 'a'")
    assert {r["column_name"] for r in body.collect()} == {"customer_id", "name", "branch"}
    assert body.select("row_pos").distinct().count() == 3


def test_sheet_choice(spark):
    s = spark.sql("SELECT * FROM VALUES ('a', 0, 'NDI Assessment'), ('a', 1, 'Customer MDM Sheet'), ('b', 0, 'First'), ('b', 1, 'Second') AS t(file, pos, sheet)")
    assert {r["file"]: r["sheet"] for r in tt.choose_sheet(s).collect()} == {"a": "Customer MDM Sheet", "b": "First"}
    assert [r["file"] for r in tt.choose_sheet(s, "ndi", fallback_first=False).collect()] == ["a"]


def test_zone_reads_report_what_is_missing(spark):
    with pytest.raises(ValueError, match="no dataset"):
        zones.read_zone(spark, None, "x")
    with pytest.raises(ValueError, match="files are missing"):
        zones.read_zone(spark, scratch_path(spark, "nothing"), "x")


def test_lakehouse_round_trip(spark):
    df = spark.range(3).select(F.col("id"), F.lit("v").alias("note"))
    assert not zones.ready(spark, "silver.tiny")
    out = lakehouse.promote_dataset(spark, df, "tiny")
    assert zones.ready(spark, "silver.tiny") and [r["uri"] for r in out.collect()] == ["silver.tiny", "gold.tiny_ndi"]
    assert spark.table("gold.tiny_ndi").first()[0] == 48.3 and not spark.catalog.tableExists("gold.tiny_ifrs9")
    lakehouse.silver_to_table(df.limit(1), "tiny")
    assert spark.table("silver.tiny").count() == 1
    with pytest.raises(ValueError, match="empty"):
        lakehouse.promote_dataset(spark, df.where("false"), "nil")


def test_loads_of_one_second_stay_apart(spark):
    root, df = scratch_path(spark, "loads"), spark.range(3)
    paths = {zones.land_bronze(df, root, "d", "t"), zones.land_bronze(df, root, "d", "t"), zones.land_bronze(df, root, "d", "t", "one")}
    assert [spark.read.parquet(p).count() for p in paths] == [3, 3, 3]
    with pytest.raises(Exception, match="already exists"):
        zones.land_bronze(df, root, "d", "t", "one")


def test_failed_write_leaves_the_old_table(spark):
    zones.write_table(spark.range(4), "silver.kept-name")
    broken = spark.range(2).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="broken"):
        zones.write_table(broken, "silver.kept-name")
    assert spark.table(zones.quoted("silver.kept-name")).count() == 4
    assert zones.write_table(spark.range(5).withColumn("more", F.lit("x")), "silver.kept-name") == 5
    names = {zones.quoted(f"silver.{n}") for n in ("a-b", "a_x2d_b", "a_b", "a.b", "2024")}
    assert len(names) == 5 and zones.ready(spark, "silver.kept-name") and not zones.ready(spark, "silver.a-b")


def test_shapes_and_common_types(spark):
    df = spark.createDataFrame([(" 12 ", "9223372036854775807", "92233720368547758070", "1"), ("-3", "1", "1", "x")], "a string, b string, c string, d string")
    assert tt.infer_types(df) == {"a": "bigint", "b": "bigint", "c": "string", "d": "string"}
    over = spark.createDataFrame([("9999999999999999999",), ("1",)], "a string")
    assert tt.infer_types(over) == {"a": "double"}
    assert [tt.common_type(t) for t in ({"int", "bigint"}, {"int", "double"}, {"bigint", "string"}, {"date", "int"})] == ["bigint", "double", "string", "string"]


def test_header_needs_a_body(spark):
    cells = spark.createDataFrame([("f", 0, ["a", ""]), ("f", 1, ["x", "y"]), ("g", 0, ["only", "one"])], "file string, row_pos int, cells array<string>")
    assert {r["file"]: r["header_row"] for r in tt.header_rows(cells).collect()} == {"f": 0}


def test_documents(spark, tmp_path):
    for name in ("policy_v1.PDF", "notes.txt"):
        (tmp_path / name).write_bytes(b"x" * 5)
    listed = zones.listed_documents(spark, str(tmp_path)).withColumn("uploaded_by", F.lit("u"))
    check = lambda df: {r["storage_key"]: r["reason"] for r in zones.accept_documents(df, P.DOCUMENT_EXTENSIONS, P.DOCUMENT_MAX_BYTES).collect()}
    assert check(listed) == {"policy_v1.PDF": None, "notes.txt": "file type not allowed"}
    rows = spark.sql("SELECT * FROM VALUES (' my plan.doc', 0L, 'u'), ('big.docx', 10485761L, 'u'), ('ok.docx', 10485760L, 'u'), ('anon.pdf', 5L, ' '), ('  ', 5L, 'u') AS t(filename, size_bytes, uploaded_by)")
    assert check(rows) == {"my_plan.doc": "file is empty", "big.docx": "file is too large", "ok.docx": None, "anon.pdf": "the uploader must be named", None: "a file name is required"}


# ---- names and roles -------------------------------------------------------------------------

def test_safe_names(spark):
    f = lambda s: spark.range(1).select(X.safe_name(F.lit(s))).first()[0]
    assert [f(s) for s in ("  My file (v2).csv ", "__x__", "بيانات-1", " !! ", "a\tb")] == ["My_file__v2__csv", "x", "بيانات-1", "unnamed_dataset", "a_b"]


def test_matchers_are_not_interchangeable():
    cols = ["target_name", "Full Name", "CUST_ID", "full_name"]
    assert roles.find_containing(cols, ("name", "cust")) == "target_name"
    assert roles.find_exact(cols, ("cust_id",)) == "CUST_ID"
    assert roles.find_candidate(cols, ("full_name",)) == "full_name"
    assert roles.find_candidate(["Name", "FULL NAME"], ("full_name", "name")) == "FULL NAME"
    assert [c for c in ("CUST_ID", "NATIONAL_ID", "PHONE", "PRODUCTS", "identity", "Zip Code", "phone_2") if not roles.is_identifier(c)] == ["PRODUCTS", "identity"]


def test_only_quantities_are_summarised(spark):
    df = spark.sql("SELECT 'c' AS CUST_ID, 1L AS NATIONAL_ID, 5L AS PHONE, 3 AS PRODUCTS, CAST(NULL AS INT) AS EMPTY")
    assert roles.quantity_columns(df) == ["PRODUCTS", "EMPTY"]
    assert [r["column_name"] for r in prof.numeric_summary(df).collect()] == ["PRODUCTS"]


def test_scorecard_roles(spark):
    named = spark.sql("SELECT 1 AS `#`, 'ar' AS `Domain (Arabic)`, 'en' AS `Domain (English)`, 2.0D AS `Current Score`, 4.0D AS `Target Score`, 2.0D AS Gap, 'High' AS Priority")
    assert roles.scorecard_roles(named) == ("Current Score", "Target Score", "Domain (English)")
    assert roles.scorecard_roles(spark.sql("SELECT 1 AS index, 'd' AS Domain, 2.0D AS now, 3.0D AS goal")) == ("now", "goal", "Domain")
    with pytest.raises(ValueError, match="exactly two"):
        roles.scorecard_roles(spark.sql("SELECT 1.0D AS a, 2.0D AS b, 3.0D AS c"))
    with pytest.raises(ValueError, match="numeric"):
        roles.scorecard_roles(spark.sql("SELECT 'x' AS current, 2.0D AS target"))


def test_classification(spark):
    cols = spark.sql("""SELECT * FROM VALUES ('bank', 0, 'CUST_ID', 0, 600), ('bank', 1, 'NATIONAL_ID', 12, 600), ('bank', 2, 'Customer Email', 90, 600),
        ('bank', 3, 'monthly_salary', 400, 600), ('shop', 0, 'incomes', 0, 500), ('shop', 1, 'mobile_number', 0, 500), ('empty', 0, 'email', 0, 0) AS t(dataset, pos, column_name, null_count, rows)""")
    out = classify.classify(cols)
    got = {r["column_name"]: (r["tier"], r["matched_keyword"], r["completeness_pct"]) for r in out.collect()}
    assert got == {"CUST_ID": ("INTERNAL", None, 100.0), "NATIONAL_ID": ("RESTRICTED", "national_id", 98.0), "Customer Email": ("CONFIDENTIAL", "email", 85.0),
                   "monthly_salary": ("RESTRICTED", "salary", 33.3), "incomes": ("INTERNAL", None, 100.0), "mobile_number": ("CONFIDENTIAL", "mobile", 100.0), "email": ("CONFIDENTIAL", "email", None)}
    cover = {r["dataset"]: (r["restricted"], r["confidential"], r["personal_completeness_pct"]) for r in classify.coverage(out).collect()}
    assert cover == {"bank": (2, 1, 72.1), "shop": (0, 1, 100.0), "empty": (0, 1, None)}


def test_rules(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', 'p'), (2, NULL, 'p'), (2, 'b', NULL), (4, 'c', 'q') AS t(order_id, note, phone)")
    got = {(r["rule_type"], r["column_name"]): r for r in rules.run_rules(df).collect()}
    assert got[("values_not_null", "note")]["status"] == "pass" and got[("values_not_null", "note")]["unexpected_percent"] == 25.0
    unique = got[("values_unique", "order_id")]
    assert (unique["status"], unique["element_count"], unique["unexpected_count"], unique["unexpected_percent"]) == ("fail", 4, 2, 50.0)
    assert got[("values_unique", "phone")]["unexpected_percent"] == 66.67
    assert got[("duplicate_detection_run", None)]["status"] == "warn"
    assert rules.rule_summary(rules.run_rules(df, True)).first() == (7, 5)


def test_code_lists(spark):
    published = spark.createDataFrame([("SA", "Saudi Arabia"), ("GB", "United Kingdom")], "code string, label string")
    values = code_lists.standard_values(spark, published)
    counts = {r["slug"]: r["count"] for r in values.groupBy("slug").count().collect()}
    assert counts[code_lists.CURRENCIES] == 37 and counts[code_lists.REGIONS] == 13 and counts[code_lists.COUNTRIES] == 2
    assert values.where("code = 'SA' AND label = 'Saudi Arabia'").count() == 1


def test_top_categories_in_one_pass(spark):
    df = spark.range(60_000, numPartitions=6).select(
        F.concat(F.lit("g"), F.col("id") % 20).alias("grp"), F.concat(F.lit("w"), F.col("id") % 21).alias("wide"), F.col("id").cast("string").alias("name"),
        F.when(F.col("id") % 5 == 0, F.lit("x")).alias("sparse"), F.lit(None).cast("string").alias("nothing"))
    found = {}
    for r in prof.top_categories(df).collect():
        found.setdefault(r.column_name, []).append((r.rank, r.value, r.n))
    assert sorted(found) == ["grp", "sparse"] and found["sparse"] == [(1, "x", 12_000)]
    assert sorted(found["grp"]) == [(k + 1, v, 3000) for k, v in enumerate(sorted(f"g{i}" for i in range(20))[:5])]
    assert prof.top_categories(df.limit(0)).count() == 0 and prof.top_categories(df.select(F.lit(1).alias("n"))).count() == 0
