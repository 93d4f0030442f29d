"""Readers, writers and the pipeline over files."""

from __future__ import annotations

import glob
from decimal import Decimal

import pytest
from frames import frame, master, tuples
from pyspark.sql import types as T

from tallybook import schemas
from tallybook.plans import collate, pipeline
from tallybook.sources import (
    missing_files,
    read_csv,
    read_dataset,
    read_ledgers,
    write_csv,
    write_dataset,
)

HEADER = "Entity,Expense Type,Expense area,Supplier,AP Amount (£)\n"


@pytest.fixture
def ledger_dir(tmp_path):
    folder = tmp_path / "ledgers"
    folder.mkdir()
    (folder / "00 North+body 5%.csv").write_text(
        HEADER + 'North body,Rent,NA,"Smith, Jones",30000.50\nNorth body,Rent,Estates,NA,-10\n',
        encoding="utf-8",
    )
    (folder / "01 South body.csv").write_text(
        HEADER + 'South body,NA,Estates,Acme,26000\nSouth body,"",Estates,acme,NA\n',
        encoding="utf-8",
    )
    (folder / "99 not listed.csv").write_text(HEADER + "Other,a,b,c,1\n", encoding="utf-8")
    return str(folder)


def _manifest(spark):
    rows = [("00 North+body 5%.csv",), ("01 South body.csv",), ("02 missing.csv",)]
    return frame(spark, "FileName string", rows)


def test_ledgers_come_from_the_manifest_only(spark, ledger_dir):
    got = tuples(read_ledgers(spark, ledger_dir, _manifest(spark)))
    assert sorted(got, key=str) == sorted(
        [
            ("North body", "Rent", None, "Smith, Jones", Decimal("30000.50"), "00 North+body 5%.csv"),
            ("North body", "Rent", "Estates", None, Decimal("-10.00"), "00 North+body 5%.csv"),
            ("South body", None, "Estates", "Acme", Decimal("26000.00"), "01 South body.csv"),
            ("South body", "", "Estates", "acme", None, "01 South body.csv"),
        ],
        key=str,
    )
    assert read_ledgers(spark, ledger_dir).count() == 5


def test_listed_but_missing_files_are_found(spark, ledger_dir):
    assert tuples(missing_files(spark, ledger_dir, _manifest(spark))) == [("02 missing.csv",)]


def test_wrong_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Entity,Supplier\nx,y\n", encoding="utf-8")
    with pytest.raises(Exception):
        read_ledgers(spark, str(tmp_path)).collect()


def test_lookup_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "codes.csv"
    text = 'FID,CCG18CD,CCG18CDH,CCG18NM,OurNames\n1,E1,X,"A, B","A and B"\n'
    path.write_bytes(b"\xef\xbb\xbf" + text.encode())
    got = tuples(read_csv(spark, str(path), schemas.BODY_CODES))
    assert got == [(1, "E1", "X", "A, B", "A and B")]


def test_csv_round_trip_keeps_missing_and_empty(spark, tmp_path):
    df = frame(spark, "a string, b int", [("x", 1), (None, None), ("", 2), ('q"uote', 3)])
    write_csv(df, str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(tuples(back), key=str) == sorted(tuples(df), key=str)
    text = "".join(open(p).read() for p in glob.glob(str(tmp_path / "out" / "*.csv")))
    assert "NA,NA" in text


def test_dataset_round_trip(spark, tmp_path):
    df = frame(spark, "a string, b decimal(18,2)", [("x", Decimal("1.10")), (None, None)])
    write_dataset(df, str(tmp_path / "out"))
    assert sorted(tuples(read_dataset(spark, str(tmp_path / "out"))), key=str) == sorted(
        tuples(df), key=str
    )


def test_pipeline_end_to_end(spark, ledger_dir, tmp_path):
    codes = frame(
        spark,
        "FID int, CCG18CD string, CCG18CDH string, CCG18NM string, OurNames string",
        [(1, "E1", "a", "n", "North body"), (2, "E2", "b", "s", "South body")],
    )
    known = master(
        spark,
        [
            {"Supplier": "SMITH, JONES", "VCSE_Status": 1},
            {"Supplier": "ACME", "NHS": 1, "SupplierSector": "NHS"},
        ],
    )
    out = str(tmp_path / "out")
    raw = read_ledgers(spark, ledger_dir, _manifest(spark))
    clean = pipeline.build_invoices(raw, codes, out)
    assert clean.columns == schemas.INVOICES.names
    names = frame(spark, "Supplier string", []).schema
    assert sorted(tuples(read_csv(spark, f"{out}/unique_suppliers", names)), key=str) == [
        ("ACME",), ("SMITH, JONES",), (None,),
    ]
    combined, extract = pipeline.build_datasets(clean, known, out)
    assert combined.count() == 4
    assert extract.columns == schemas.EXTRACT_COLUMNS
    assert sorted(tuples(extract, "CCGName", "CCGCode", "Supplier", "Spending")) == [
        ("NORTH BODY", "E1", "SMITH, JONES", Decimal("30000.50")),
        ("SOUTH BODY", "E2", "ACME", Decimal("26000.00")),
    ]
    people = frame(spark, "CCGCode string, Mid2018Pop bigint", [("E1", 1000), ("E2", 2000)])
    places = frame(
        spark,
        "CCGCode2018 string, CCGCode2020 string, CCGName2020 string",
        [("E1", "U1", "Unit one"), ("E2", "U1", "Unit one")],
    )
    shared = frame(spark, "CCGName string", [("NORTH BODY",), ("ELSEWHERE",)])
    tally = read_dataset(spark, f"{out}/tally")
    tables = pipeline.report_tables(tally, people, places, shared)
    tables.update(pipeline.body_tables(tally, ["NORTH BODY"]))
    tables.update(pipeline.profile_tables(tally, places, ["NORTH BODY"], ["Unit one"]))
    pipeline.write_tables(tables, f"{out}/reports")
    split = read_csv(spark, f"{out}/reports/threshold_split", schemas.THRESHOLD_SPLIT)
    assert sorted(tuples(split)) == [
        ("NORTH BODY", "E1", 1, 1, 1.0, 0.0, 1),
        ("SOUTH BODY", "E2", 1, 1, 1.0, 0.0, 2),
    ]
    assert len(tables) == len(glob.glob(f"{out}/reports/*/_SUCCESS"))
    units = spark.read.csv(f"{out}/reports/successor_case_study", header=True)
    assert tuples(units, "CCGName2020", "VCSESpend", "Population", "ID") == [
        ("Unit one", "30000.50", "3000", "1")
    ]
    flags = spark.read.csv(f"{out}/reports/register_flags_by_body", header=True, nullValue="NA")
    assert sorted(tuples(flags)) == [("ELSEWHERE", None, None), ("NORTH BODY", "0", "0")]


def test_stages_from_the_command_line(spark, ledger_dir, tmp_path):
    from tallybook.__main__ import main

    def text(name: str, content: str) -> str:
        path = tmp_path / name
        path.write_bytes(b"\xef\xbb\xbf" + content.encode())
        return str(path)

    out = str(tmp_path / "out")
    codes = text("codes.csv", "FID,CCG18CD,CCG18CDH,CCG18NM,OurNames\n1,E1,a,n,North body\n")
    listed = text("list.csv", "FileName\n00 North+body 5%.csv\n")
    collate = ["collate", "--ledgers", ledger_dir, "--codes", codes, "--out", out]
    gone = text("gone.csv", "FileName\n00 North+body 5%.csv\nnowhere.csv\n")
    with pytest.raises(SystemExit, match="nowhere.csv"):
        main([*collate, "--manifest", gone])
    main([*collate, "--manifest", listed])
    texts = {"SupplierSector": "Other", "CCCH_Status": "NotCCorCH"}
    row = [
        "1" if f.dataType.simpleString() == "int" else texts.get(f.name, "x")
        for f in schemas.SUPPLIERS.fields
    ]
    row[0] = '"SMITH, JONES"'
    for flag in schemas.VALIDITY_FLAGS:
        row[schemas.SUPPLIERS.names.index(flag)] = "0"
    master_file = text(
        "master.csv", ",".join(["More", *schemas.SUPPLIERS.names]) + "\n?," + ",".join(row) + "\n"
    )
    main(["enrich", "--suppliers", master_file, "--out", out])
    people = text("people.csv", "CCGCode,Mid2018Pop\nE1,1000\n")
    places = text("places.csv", ",".join(schemas.GEOGRAPHY.names) + "\n" + ",".join(["E1"] * 9) + "\n")
    shared = text("shared.csv", "CCGName\nNORTH BODY\n")
    looked = ["--geography", places, "--out", out]
    report = ["report", "--population", people, "--shared", shared, *looked, "--body", "NORTH BODY"]
    main([*report, "--nth", "NORTH BODY=1,2", "--supplier", "x", "--spend-cut", "10", "--case-rank", "1"])
    for name, rows in (("nth_supplier_share", 1), ("supplier_by_body", 1), ("spend_bands", 1)):
        assert spark.read.csv(f"{out}/report/{name}", header=True).count() == rows
    studies = spark.read.csv(f"{out}/report/per_capita_spend", header=True)
    assert tuples(studies, "CaseStudyShortList") == [("CaseStudy",)]
    assert tuples(spark.read.parquet(f"{out}/shared"), "CCGName", "Supplier") == [("NORTH BODY", "SMITH, JONES")]
    main(["profile", *looked, "--body", "NORTH BODY", "--successor", "E1"])
    ranks = spark.read.csv(f"{out}/profile/successor_value_share", header=True)
    assert tuples(ranks, "CCGName2020", "PercentVCSESpend", "Rank") == [("E1", "1.0", "1")]
    assert spark.read.csv(f"{out}/files/file_summary", header=True).count() == 1


def test_extract_filters_reach_the_stored_scan(spark, ledger_dir, tmp_path):
    from tallybook.plans import enrich

    known = master(spark, [{"Supplier": "ACME"}])
    codes = frame(
        spark,
        "FID int, CCG18CD string, CCG18CDH string, CCG18NM string, OurNames string",
        [(2, "E2", "b", "s", "South body")],
    )
    out = str(tmp_path / "out")
    clean = pipeline.build_invoices(read_ledgers(spark, ledger_dir), codes, out)
    combined, _ = pipeline.build_datasets(clean, known, out)
    lean = enrich.extract_from_combined(combined).select("CCGName", "Spending")
    plan = lean._jdf.queryExecution().executedPlan().toString()
    for pushed in ("EqualTo(InvoiceOver25k,1)", "IsNotNull(Supplier)", "EqualTo(Redacted,0)"):
        assert pushed in plan
    assert "ExpenseType" not in plan.split("ReadSchema")[1]


def _ledger_file(folder, name: str, *lines: str) -> None:
    header = '"Entity","Expense Type","Expense area","Supplier","AP Amount (£)"'
    (folder / name).write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")


def test_quotes_and_commas_make_the_round_trip(spark, tmp_path):
    names = [("A \"B\", C",), ("THE \"X\" TRUST",), ("a\\b",), ("plain",), (None,)]
    write_csv(spark.createDataFrame(names, "Name string"), str(tmp_path / "out"))
    schema = T.StructType([T.StructField("Name", T.StringType())])
    assert sorted(tuples(read_csv(spark, str(tmp_path / "out"), schema)), key=str) == sorted(names, key=str)
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))
    assert '"A ""B"", C"' in text and "\\\"" not in text


def test_a_file_off_the_manifest_is_not_opened(spark, tmp_path):
    _ledger_file(tmp_path, "one.csv", '"one","t","a","THE ""X"" TRUST, LTD",10.50')
    _ledger_file(tmp_path, "empty.csv")
    (tmp_path / "stray.csv").write_text("something,else\n1,2\n")
    manifest = spark.createDataFrame([("one.csv",), ("empty.csv",)], "FileName string").coalesce(1)
    raw = read_ledgers(spark, str(tmp_path), manifest)
    assert tuples(raw, "Supplier", "File") == [('THE "X" TRUST, LTD', "one.csv")]
    summary = collate.file_summary(raw, manifest=manifest)
    got = sorted(tuples(summary, "Count", "File", "CCG", "Suppliers", "Invoices"))
    assert got == [(1, "one.csv", "one", 1, 1), (2, "empty.csv", None, 0, 0)]


def test_digits_beyond_pennies_fail(spark, tmp_path):
    _ledger_file(tmp_path, "one.csv", '"one","t","a","S",24999.996')
    with pytest.raises(Exception, match="more than two decimals: 24999.996"):
        read_ledgers(spark, str(tmp_path)).collect()
    _ledger_file(tmp_path, "one.csv", '"one","t","a","S",24999.9900', '"one","t","a","S",NA')
    got = tuples(read_ledgers(spark, str(tmp_path)), "`AP Amount (£)`")
    assert sorted(got, key=str) == [(Decimal("24999.99"),), (None,)]


def test_line_breaks_inside_quoted_values(spark, tmp_path):
    folder = tmp_path / "ledgers"
    folder.mkdir()
    (folder / "a.csv").write_bytes(
        (HEADER + 'Body,Rent,"Es\r\ntates","ACME\nLTD",1.50\nBody,"a\n\n""b""",NA,"x,\ny",-2\n').encode()
    )
    (folder / "b.csv").write_text(HEADER + 'Body,NA,NA,"\nlead",3\n', encoding="utf-8")
    got = sorted(tuples(read_ledgers(spark, str(folder))), key=str)
    assert got == sorted(
        [
            ("Body", "Rent", "Es\r\ntates", "ACME\nLTD", Decimal("1.50"), "a.csv"),
            ("Body", 'a\n\n"b"', None, "x,\ny", Decimal("-2.00"), "a.csv"),
            ("Body", None, None, "\nlead", Decimal("3.00"), "b.csv"),
        ],
        key=str,
    )
    summary = tuples(collate.file_summary(read_ledgers(spark, str(folder))), "File", "Suppliers", "Invoices")
    assert sorted(summary) == [("a.csv", 2, 2), ("b.csv", 1, 1)]


def test_csv_round_trip_keeps_line_breaks(spark, tmp_path):
    values = ["ACME\nLTD", "a\r\nb", "\n", 'say ""no""\n"', "x,\ny", " lead", "NA ", None, ""]
    df = frame(spark, "a string, b int", [(v, k) for k, v in enumerate(values)]).coalesce(1)
    write_csv(df, str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(tuples(back, "b", "a"), key=str) == sorted(tuples(df, "b", "a"), key=str)


def test_a_file_too_large_for_one_task_is_refused(spark, ledger_dir, monkeypatch):
    from tallybook.sources import files

    monkeypatch.setattr(files, "MAX_FILE_BYTES", 100)
    with pytest.raises(ValueError, match="line_breaks=False"):
        read_ledgers(spark, ledger_dir)
    assert read_ledgers(spark, ledger_dir, line_breaks=False).count() == 5
