"""File sources and sinks against plain Python on small files."""

import csv as plain_csv
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from typeweave.operators import encode, seq
from typeweave.sources import delimited, fasta, sequences, sinks, spreadsheet, worklist


def listed(spark, path):
    return [r["value"] for r in spark.read.text(str(path)).collect()]


def test_fasta_in_three_readings(spark, tmp_path):
    folder = tmp_path / "asm"
    (folder / "below").mkdir(parents=True)
    (folder / "one.v2.fasta").write_bytes(b">a first > odd\r\nacg\r\n  TT \r\n\r\n>a second\nGG\n>a first > odd\nnnn\n>empty\n\n>b\n" + b"ac\n" * 50_000 + b"\n\n")
    (folder / "below" / "two.fasta").write_text("\n>\nCC\n>c x\nGATTACA")
    (folder / "three.fa").write_text(">z\nAAA\n")
    found = fasta.records(spark, str(folder))
    assert sorted((r["stem"], r["header"], len(r["seq"])) for r in found.collect()) == [
        ("one.v2", "a first > odd", 3), ("one.v2", "a first > odd", 5), ("one.v2", "a second", 2), ("one.v2", "b", 100_000), ("two", "", 2), ("two", "c x", 7),
    ]
    whole = {(r["stem"], r["id"]): r["seq"] for r in fasta.by_header(found).collect()}
    assert {k: v for k, v in whole.items() if k[1] != "b"} == {("one.v2", "a first > odd"): "NNN", ("one.v2", "a second"): "GG", ("two", "c x"): "GATTACA"}
    assert whole["one.v2", "b"] == "AC" * 50_000
    first = {(r["stem"], r["id"]): r["seq"] for r in fasta.by_first_word(found).collect()}
    assert first["one.v2", "a"] == "NNN" and first["two", "c"] == "GATTACA" and len(first) == 3
    figures = {r["stem"]: (r["contigs"], r["n50"], r["status"]) for r in seq.quality(found, "stem", "seq", 5, 100_010, 7).collect()}
    assert figures == {"one.v2": (4, 100_000, "PASS"), "two": (2, 7, "PASS")}


def test_records_of_a_file_in_many_splits_keep_their_order(spark, tmp_path):
    (tmp_path / "x.fasta").write_text("".join(f">k{i % 7}\n{'acgt'[i % 4] * 30}{'c' * (i % 50)}\n" for i in range(3_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = fasta.records(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 8
        got = {r["id"]: r["seq"] for r in fasta.by_header(found).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"k{i % 7}": "ACGT"[i % 4] * 30 + "C" * (i % 50) for i in range(2_993, 3_000)}


def test_lists_hits_and_csv_readings(spark, tmp_path):
    (tmp_path / "list.txt").write_bytes("﻿SRR1 \r\n\r\n  GCA_2\n".encode())
    assert [r["line"] for r in delimited.lines(spark, str(tmp_path / "list.txt")).collect()] == ["SRR1", "GCA_2"]
    (tmp_path / "hits.tsv").write_text("c1\t99.5\t100\t100\t5\t104\tplus\t180\nshort\t1\nc2\t98\t50\t100\t9\t1\tminus\t180.5\textra\n")
    hits = delimited.hits(spark, str(tmp_path / "hits.tsv")).collect()
    assert [(r["sseqid"], r["length"], r["send"], r["bitscore"]) for r in hits] == [("c1", 100, 104, 180.0), ("c2", 50, 1, 180.5)]
    (tmp_path / "t.csv").write_bytes("﻿Accession ,ST,Year\r\na,NA,\r\nb,,nan\r\nc,7,2001\r\n".encode())
    read = lambda missing: [tuple(r) for r in delimited.csv(spark, str(tmp_path / "t.csv"), missing).orderBy("Accession").collect()]
    assert delimited.csv(spark, str(tmp_path / "t.csv")).columns == ["Accession", "ST", "Year"]
    assert read("usual") == [("a", None, None), ("b", None, None), ("c", "7", "2001")]
    assert read("empty") == [("a", "NA", None), ("b", None, "nan"), ("c", "7", "2001")]
    assert read("never") == [("a", "NA", ""), ("b", "", "nan"), ("c", "7", "2001")]


def test_headers_of_several_lines_and_a_family_of_columns(spark, tmp_path):
    with open(tmp_path / "wide.csv", "w", newline="") as f:
        w = plain_csv.writer(f)
        w.writerow(["﻿Sample ID\nof all", "ST", "g1\n(core)", "Perc. Good\n(core)", "g2 x\n(core)", "h\n(other)"])
        w.writerow([" s1 ", "5", "3", "99", "? (new)", "1"])
    got = delimited.wide_export(spark, str(tmp_path / "wide.csv"), ["Sample ID", "ST"], "(core)", ("Perc.", "Complex")).collect()
    assert [tuple(r) for r in got] == [("s1", "5", [3.0, None])]
    df = spark.createDataFrame([("NA", "yes"), ("4", "no"), ("5", None)], "ST string, has_missing_data string")
    assert [r["ST"] for r in delimited.without_missing_data(df).collect()] == ["4", "5"]
    assert [r["ST"] for r in delimited.without_missing_data(df.drop("has_missing_data")).collect()] == ["4", "5"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "CC", "l1"), ("a", "GG", "l1"), ("a", "TT", "l2")], "strain string, seq string, locus string")
    for _ in range(2):
        sinks.appended_tsv(df.coalesce(1), str(tmp_path / "t.tsv"))
    lines = listed(spark, tmp_path / "t.tsv")
    assert len(lines) == 8 and lines.count("strain\tseq\tlocus") == 2 and lines.count("b\tCC\tl1") == 2
    sinks.fasta(df, "strain", "seq", str(tmp_path / "loci"), by="locus")
    assert {p.name for p in (tmp_path / "loci").iterdir() if p.is_dir()} == {"locus=l1", "locus=l2"}
    whole = seq.concatenated(df, "strain", "locus", "seq", spark.createDataFrame([("l1", 2), ("l2", 2), ("l3", 1)], "locus string, length int"))
    path = sinks.concatenated_fasta(whole, "strain", "seq", str(tmp_path), "six")
    assert Path(path).is_file() and path.endswith("concat_six_2.fasta") and listed(spark, path) == [">a", "GGTTN", ">b", "CCNNN"]
    blocks = seq.partitions(spark.createDataFrame([("l1", 2), ("l2", 3)], "locus string, length long"), "locus", "length")
    sinks.partition_file(blocks, "locus", str(tmp_path / "parts.txt"))
    assert listed(spark, tmp_path / "parts.txt") == ["DNA, l1 = 1-2", "DNA, l2 = 3-5"]
    records = spark.createDataFrame([("x", 1, True, ["l1", "l2"]), ("y", None, None, [])], "entity string, st int, is_novel boolean, missing array<string>")
    sinks.records(records, str(tmp_path / "r.csv"))
    assert {tuple(r) for r in delimited.csv(spark, str(tmp_path / "r.csv"), "never").collect()} == {("x", "1", "yes", "l1;l2"), ("y", "NA", "NA", "")}
    sinks.metrics(spark.createDataFrame([("six", 0.5, 3)], "scheme string, d double, types int"), ["scheme"], str(tmp_path / "m.csv"))
    assert {tuple(r) for r in delimited.csv(spark, str(tmp_path / "m.csv"), "never").collect()} == {("six", "d", "0.5"), ("six", "types", "3")}
    members = spark.createDataFrame([("e1", "p", "c", True, False), ("e2", "p", None, None, True), ("e3", "q", "c", True, True)], "entity string, profile string, cluster string, in_a boolean, in_l boolean")
    sinks.catalogue(encode.catalogue(members), members, str(tmp_path / "cat"))
    assert {(r["entity"], r["pst"]) for r in delimited.csv(spark, str(tmp_path / "cat" / "entities.csv"), "never").collect()} == {("e1", "1"), ("e2", "1"), ("e3", "2")}
    assert {r["reps"] for r in delimited.csv(spark, str(tmp_path / "cat" / "catalogue.csv"), "never").collect()} == {"e1;e2", "e3"}
    sinks.report(spark.createDataFrame([("six", 0.5), ("seven", None)], "scheme string, d double"), {"scheme": 8, "d": 6}, "PANEL", str(tmp_path / "out.txt"))
    assert listed(spark, tmp_path / "out.txt") == ["PANEL", "scheme       d", "seven        -", "six        0.5"]


def test_empty_folders_of_files_are_an_error_and_empty_files_are_not(spark, tmp_path):
    (tmp_path / "e.fasta").write_text("")
    assert fasta.records(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception):
        delimited.lines(spark, str(tmp_path / "absent")).count()
    assert delimited.packed(spark.range(1).withColumn("x", F.lit("7")), ["x"]) is not None


def test_one_file_is_whole_or_absent(spark, tmp_path):
    path = tmp_path / "lines.txt"
    lines = spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("value"))
    for _ in range(2):  # a rerun replaces it
        sinks.one_file(lines, str(path))
        assert path.read_text() == "".join(f"{k}\n" for k in range(1000))
    broken = lines.select(F.when(F.col("value") == "999", F.raise_error(F.lit("no"))).otherwise(F.col("value")).alias("value"))
    with pytest.raises(Exception):
        sinks.one_file(broken, str(tmp_path / "broken.txt"))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["lines.txt"]


def test_text_before_the_first_header_is_sequence_without_a_header(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("junk\nACGT\n>h1 x\nac\n>h2\ngg\n")
    (tmp_path / "b.fasta").write_text(">h1\ntt\n")
    found = fasta.records(spark, str(tmp_path))
    assert sorted((r["stem"], r["header"], r["seq"]) for r in found.collect()) == [("a", "", "JUNKACGT"), ("a", "h1 x", "AC"), ("a", "h2", "GG"), ("b", "h1", "TT")]
    assert sorted((r["stem"], r["id"]) for r in fasta.by_first_word(found).collect()) == [("a", "h1"), ("a", "h2"), ("b", "h1")]


def test_headers_with_back_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text("a`b,x y\n1,NA\n")
    assert [tuple(r) for r in delimited.csv(spark, str(tmp_path / "q.csv")).collect()] == [("1", None)]


def test_ranges_across_chunks_against_slices(spark, monkeypatch):
    monkeypatch.setattr(sequences, "CHUNK", 7)
    monkeypatch.setattr(sequences, "TOGETHER", 3)
    rng = random.Random(12)
    texts = {f"c{k}": "".join(rng.choices("ACGTnxé\U0001f600", k=k * k * 5)) for k in range(7)}
    hits = [(k, f"c{rng.randrange(8)}", rng.randrange(-3, 190), rng.randrange(-3, 190)) for k in range(150)] + [(150, "c3", None, 4), (151, None, 1, 4)]
    df = spark.createDataFrame(hits, "hit long, contig string, a long, b long").withColumns({c: F.lit(c) for c in ("chunk", "low", "piece")})
    store = sequences.store(spark.createDataFrame([*texts.items(), ("c9", None)], "name string, seq string"), "name", "seq")
    got = {r["hit"]: r["part"] for r in sequences.ranges(store, df, "contig", "a", "b").collect()}
    assert len(got) == len(hits)
    for k, contig, a, b in hits:
        whole = texts.get(contig, "") if a is not None else ""
        part = whole[max(min(a, b) - 1, 0) : max(max(a, b), 0)] if whole else ""
        part = part if not part or a <= b else part[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert (got[k] or "") == part, k


def test_batches_are_appended_once_and_followed(spark, tmp_path):
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    df = spark.createDataFrame([(k,) for k in range(10)], "k long")
    assert worklist.appended(spark, folder, df.schema).count() == 0
    assert worklist.append_once(df.where("k < 4"), folder, "a b/c") and not worklist.append_once(df, folder, "a b/c")
    assert sorted(r["k"] for r in worklist.pending(df, folder, "k", df.schema).collect()) == [4, 5, 6, 7, 8, 9]
    for low in (4, 7):
        df.where(F.col("k").between(low, low + 2)).write.mode("append").parquet(source)
        for _ in range(2):  # the second call finds nothing new
            worklist.followed(spark, source, df.schema, folder, "stream", lambda x: x.where("k <> 9"))
    assert sorted(r["k"] for r in worklist.appended(spark, folder, df.schema).collect()) == list(range(9))
    broken = df.select(F.when(F.col("k") == 9, F.raise_error(F.lit("no"))).otherwise(F.col("k")).cast("long").alias("k"))
    with pytest.raises(Exception):
        worklist.append_once(broken, folder, "broken")
    assert worklist.appended(spark, folder, df.schema).count() == 9


def test_spreadsheets_come_back_and_are_cut_into_workbooks(spark, tmp_path):
    odd = ["", None, "NA", " a&b<c>\"' ", "_x0041_ _x005F_", "tab\there\nline\r\x00\x1f￾", "ä€\U0001f600", "x" * 40_000]
    rows = [(k, odd[k % 8], k / 4, k % 3 == 0 if k % 7 else None) for k in range(53)] + [(53, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "k int, `odd ``one``\n(core)` string, at double, book boolean").repartition(3)
    spreadsheet.spreadsheets(df, ["k"], str(tmp_path), most=20)
    assert sorted(p.name for p in tmp_path.glob("[!.]*")) == ["book-00000.xlsx", "book-00001.xlsx", "book-00002.xlsx"]
    read = spreadsheet.sheet(spark, str(tmp_path), "never")
    assert read.columns == df.columns
    flag = lambda b: "" if b is None else str(int(b))
    assert sorted(tuple(r) for r in read.collect()) == sorted((str(k), t or "", "NaN" if x != x else str(x), flag(b)) for k, t, x, b in rows)
    assert read.count() == 54 and spreadsheet.sheet(spark, str(tmp_path)).where("`odd ``one``\n(core)` IS NULL").count() == 22
    inner = [[c for _, c in spreadsheet.parsed((tmp_path / f"book-0000{n}.xlsx").read_bytes())] for n in range(3)]
    assert [int(c[0]) for part in inner for c in part[1:]] == list(range(54)) and all(c[0][1] == "odd `one`\n(core)" for c in inner)
    spreadsheet.spreadsheets(df.where("false"), ["k"], str(tmp_path / "none"))
    assert spreadsheet.sheet(spark, str(tmp_path / "none")).count() == 0


def test_spreadsheets_of_other_programs(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def book(name, rows):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="first" r:id="a"/><sheet name="second" r:id="b"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="/xl/one.xml"/><Relationship Id="b" Target="two.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si></sst>')
            z.writestr("xl/one.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
            z.writestr("xl/two.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="str"><v>z</v></c></row><row><c><v>9</v></c></row></sheetData></worksheet>')

    head = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="s"><v>0</v></c></row>'
    book("a.xlsx", head + '<row r="3"/><row r="9"><c r="D9" t="e"><v>#N/A</v></c><c r="A9"><v>1.50</v></c></row><row r="10"><c r="C10" t="s"><v>1</v></c></row>')
    read = spreadsheet.sheet(spark, str(tmp_path))
    assert read.columns == ["id", "Unnamed: 1", "name", "id.1"]
    assert sorted(map(repr, map(tuple, read.collect()))) == sorted(map(repr, [("1.50", None, None, None), (None, None, "name", None)]))
    assert [r["z"] for r in spreadsheet.sheet(spark, str(tmp_path), name="second").collect()] == ["9"]
    with pytest.raises(Exception, match="no sheet third"):
        spreadsheet.sheet(spark, str(tmp_path), name="third")
    book("b.xlsx", head.replace("C2", "B2"))
    with pytest.raises(ValueError, match="more than one header"):
        spreadsheet.sheet(spark, str(tmp_path))
    book("b.xlsx", head + '<row><c r="E3"><v>1</v></c></row>')
    with pytest.raises(Exception, match="beyond the header"):
        spreadsheet.sheet(spark, str(tmp_path)).collect()


def test_only_hits_that_touch_something_are_dealt_out(spark, monkeypatch):
    written, write = {}, sequences.handed_over

    def counted(df, what):
        done = write(df, what)
        written[what] = done.count()
        return done

    monkeypatch.setattr(sequences, "CHUNK", 10)
    store = sequences.store(spark.createDataFrame([("a", "ACGT" * 6), ("b", "AC")], "name string, seq string"), "name", "seq")
    monkeypatch.setattr(sequences, "handed_over", counted)
    hits = [(0, "a", 1, 10), (1, "a", 9, 11), (2, "a", 25, 30), (3, "b", 3, 400), (4, "b", 400, 2), (5, "x", 1, 2), (6, "a", -4, 0)]
    got = {r["hit"]: r["part"] for r in sequences.ranges(store, spark.createDataFrame(hits, "hit long, contig string, a long, b long"), "contig", "a", "b").collect()}
    assert got == {0: "ACGTACGTAC", 1: "ACG", 2: None, 3: None, 4: "G", 5: None, 6: None}
    assert written["sequence-hits"] == 3 and written["sequence-crossing"] == 1


def test_records_are_not_dealt_out_to_find_headless_files(spark, tmp_path, monkeypatch):
    from typeweave.operators import seq

    (tmp_path / "a.txt").write_text(">one\n acß gt \n\n TT  \n>two\nAC GT\n>blank\n \t\n")
    (tmp_path / "b.txt").write_text("no header\n>three\r\nggNc  \n")
    headless, write = [], sequences.handed_over
    monkeypatch.setattr(fasta, "handed_over", lambda df, what: headless.append(df.count()) or write(df, what), raising=False)
    found = fasta.records(spark, str(tmp_path), "*.txt")
    assert headless == [1]
    assert {(r["header"], r["seq"]) for r in found.collect()} == {("one", "ACß GTTT "), ("two", "AC GT"), ("", "NO HEADER"), ("three", "GGNC")}
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = seq.quality(found.withColumn("k", F.lit(1)), "k", "seq", 1, 99, 1).first()
    assert got["total_bp"] == 27 and got["contigs"] == 4 and got["gc_pct"] == pytest.approx(round(100 * 7 / 27, 6))
