from functools import partial
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan, tuples
from vocspark import config
from vocspark.operators import infer, models, quality, semantic
from vocspark.plans import layers
from vocspark.sources import answers, reviews_csv, scratch, tables

CSV = (
    ',Clothing ID,Age,Title,Review Text,Rating,Recommended IND,Positive Feedback Count,'
    'Division Name,Department Name,Class Name\n'
    '0,7,33,,"Absolutely ""wonderful"", silky\nand comfortable",4,1,0,General,Tops,Blouses\n'
    '1,8,5.0,Nice,"   ",5,1,4,General,Tops,Knits\n'
    '2,8,x,"A ""bad"" one","\n",2,0,1,General,,Knits\n'
    '\n'
    '3,9,,Last,"first line\n\n""quoted"",\nend",3,1,2,General Petite,Dresses,Dresses\n'
)


@pytest.fixture()
def csv_file(tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(CSV, encoding="utf-8", newline="")
    return str(path)


def test_read_csv(spark, csv_file):
    df = reviews_csv.read_csv(spark, csv_file, partitions=3)
    rows = {r["_c0"]: r for r in df.collect()}
    assert set(rows) == {"0", "1", "2", "3"}
    assert rows["0"]["Review Text"] == 'Absolutely "wonderful", silky\nand comfortable'
    assert rows["1"]["Review Text"] == "   " and rows["2"]["Review Text"] == "\n"
    assert rows["0"]["Title"] is None and rows["2"]["Department Name"] is None
    assert rows["3"]["Review Text"] == 'first line\n\n"quoted",\nend'
    assert {t for _, t in df.dtypes} == {"string"} and df.rdd.getNumPartitions() == 3


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("split_bytes", ["40", "97", "100000"])
def test_large_csv_equals_plain_reader(spark, tmp_path, newline, split_bytes):
    folder = tmp_path / "many"
    folder.mkdir()
    for name in ("a", "b"):
        body = CSV.replace("\n", newline)
        (folder / f"{name}.csv").write_text(body, encoding="utf-8", newline="")
    want = tuples(reviews_csv.read_csv(spark, str(folder)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        split = reviews_csv.read_large_csv(spark, str(folder))
        got, names = tuples(split), split.columns
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert names[:3] == ["_c0", "Clothing ID", "Age"]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 8


@pytest.mark.parametrize("row", [
    '1,5" heel,x\n2,b,y\n', '1,b",x\n2,c,y\n', '1,"b"c,x\n', '1,a,"open\n2,b,c\n', '1,"a" ,x\n'])
def test_large_csv_refuses_stray_quotes(spark, tmp_path, row):
    path = tmp_path / "stray.csv"
    path.write_text("id,a,b\n" + row)
    with pytest.raises(Exception, match="quote outside a quoted value"):
        reviews_csv.read_large_csv(spark, str(path)).collect()


@pytest.mark.parametrize("row", [
    '1,"""x""",\n', '1,"",""\n', '1,""",b",""""\n', '1,"a "", b","c\n"",\n"\n', '"1",a""b,"x"\n'])
def test_large_csv_accepts_quoted_values(spark, tmp_path, row):
    path = tmp_path / "fine.csv"
    path.write_text("id,a,b\n" + row + '2,"p\nq",r\n')
    got = tuples(reviews_csv.read_large_csv(spark, str(path)), "id")
    assert got == tuples(reviews_csv.read_csv(spark, str(path)), "id") and len(got) == 2


def test_read_reviews_uses_the_reader_asked_for(spark, csv_file):
    plain = reviews_csv.read_reviews(spark, csv_file)
    split = reviews_csv.read_reviews(spark, csv_file, split_files=True)
    assert "Aggregate" not in plan(plain) and "Aggregate" in plan(split)
    assert tuples(plain, "_c0") == tuples(split, "_c0")


@pytest.mark.parametrize("text", ["id,a\r1,x\r2,y\r", "id,a\n1,x\r2,y\n3,z\n", 'id,a\n1,"x\ry"\n2,z\n',
                                  "id,a\r\n1,x\r\n2,y\r\n"])
def test_split_reader_never_loses_rows(spark, tmp_path, text):
    path = tmp_path / "lines.csv"
    path.write_bytes(text.encode())
    want = tuples(reviews_csv.read_csv(spark, str(path)), "id")
    try:
        got = tuples(reviews_csv.read_large_csv(spark, str(path)), "id")
    except Exception as e:
        assert "use read_csv" in str(e)
    else:
        assert got == want


def both_readers(spark, path, **options):
    return [reader(spark, str(path), **options) for reader in (reviews_csv.read_csv, reviews_csv.read_large_csv)]


def test_rows_carry_their_file(spark, tmp_path):
    for name, ids in (("a.csv", "12"), ("b c.csv", "3")):
        (tmp_path / name).write_text("id,t\n" + "".join(f'{i},"x\ny"\n' for i in ids))
    for df in both_readers(spark, tmp_path, source="_source_file"):
        got = {(r.id, r._source_file) for r in reviews_csv.add_audit(df).collect()}
        assert {(i, n.replace("%20", " ")) for i, n in got} == {("1", "a.csv"), ("2", "a.csv"), ("3", "b c.csv")}


def test_headers_that_differ_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n1,x\n")
    (tmp_path / "b.csv").write_text("a,id\ny,2\n")
    for df in both_readers(spark, tmp_path):
        with pytest.raises(Exception, match="(?i)header"):
            df.collect()


def test_blank_headers_that_differ_are_counted_as_such(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",a\r\n1,x\r\n")
    (tmp_path / "b.csv").write_text("\n,a\n1,x\n")
    assert reviews_csv.record_count(spark, str(tmp_path)).first().records == 2
    (tmp_path / "c.csv").write_text("a,\n1,x\n")
    with pytest.raises(Exception, match="headers differ"):
        reviews_csv.record_count(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("header", [",a\n", "id,id\n", "id,_c1\n", '"i d","a,b"\n'])
def test_odd_headers(spark, tmp_path, header):
    (tmp_path / "a.csv").write_text(header + "1,x\n")
    (tmp_path / "b.csv").write_text(header + "2,y\n")
    plain, split = both_readers(spark, tmp_path)
    assert plain.columns == split.columns
    assert sorted(tuples(plain)) == sorted(tuples(split)) == [("1", "x"), ("2", "y")]


def test_records_with_other_numbers_of_fields_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n1,x\n2,y,surplus\n3\n")
    for df in both_readers(spark, tmp_path, malformed="bad"):
        assert {(r.id, r.bad is not None) for r in df.collect()} == {("1", False), ("2", True), ("3", True)}
    layout = layout_in(spark, tmp_path / "db", "malformed")
    with pytest.raises(quality.CountMismatch, match="2 records"):
        layers.bronze(spark, str(tmp_path / "a.csv"), layout)
    assert layers.bronze(spark, str(tmp_path / "a.csv"), layout, allow_malformed=True).count() == 3


def test_mixed_line_ends_are_refused(spark, tmp_path):
    """`read_csv` would merge two rows of this file: the independent count shows it."""
    path = tmp_path / "mixed.csv"
    path.write_bytes(b'id,a\r\n1,x\r\n2,y\n3,"p\r\nq"\n4,"p\nq"\n')
    assert reviews_csv.record_count(spark, str(path)).first().records == 4
    with pytest.raises(Exception, match="end in different ways"):
        reviews_csv.read_large_csv(spark, str(path)).collect()
    with pytest.raises(quality.CountMismatch):
        layers.bronze(spark, str(path), layout_in(spark, tmp_path / "db", "mixed"), allow_malformed=True)


@pytest.mark.parametrize("text, records", [
    ("", 0), ("id,a\n", 0), ("id,a\n1,x", 1), ("id,a\r1,x\r2,y\r", 2), ('id,a\n1,"x\r\n\r\ny"\n\n2,z\n', 2)])
def test_record_count(spark, tmp_path, text, records):
    (tmp_path / "a.csv").write_bytes(text.encode())
    assert reviews_csv.record_count(spark, str(tmp_path / "a.csv")).first().records == records


def test_a_reader_that_loses_rows_fails_the_load(spark, tmp_path, csv_file, monkeypatch):
    whole = reviews_csv.read_reviews
    monkeypatch.setattr(reviews_csv, "read_reviews", lambda *a: whole(*a).filter("_c0 <> '2'"))
    with pytest.raises(quality.CountMismatch, match="4 records, 3 rows"):
        layers.bronze(spark, csv_file, layout_in(spark, tmp_path / "db", "loses"))


def test_names_and_audit(spark, csv_file):
    df = reviews_csv.sanitize_names(reviews_csv.read_csv(spark, csv_file))
    assert df.columns == list(config.RENAMES)
    odd = spark.createDataFrame([(1, 2)], "`a b;c` int, `x(y)=\t{z},` int")
    assert reviews_csv.sanitize_names(odd).columns == ["a_b_c", "x_y____z__"]
    audited = reviews_csv.add_audit(df)
    assert {r._source_file for r in audited.collect()} == {"reviews.csv"}
    assert reviews_csv.add_audit(df, "f.csv").first()._source_file == "f.csv"
    assert audited.filter("_ingest_timestamp IS NULL").count() == 0


def test_csv_roundtrip_keeps_spaces_and_nulls(spark, tmp_path):
    rows = [("1", "  a  "), ("2", None), ("3", ""), ("4", 'q"q\n,x'), ("5", "   ")]
    df = spark.createDataFrame(rows, "id string, t string")
    reviews_csv.write_csv(df, str(tmp_path / "c"))
    rows[2] = ("3", None)  # the CSV reader has no empty strings
    assert tuples(reviews_csv.read_csv(spark, str(tmp_path / "c")), "id") == rows
    assert tuples(reviews_csv.read_large_csv(spark, str(tmp_path / "c")), "id") == rows


@pytest.mark.parametrize("setting, base", [("/shared/x/", "/shared/x/a-"), (None, "/")])
def test_shared_folder_follows_the_session_setting(setting, base):
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: setting),
        sparkContext=SimpleNamespace(master="local[2]"))
    first, second = (scratch.shared_folder(session, "a") for _ in range(2))
    assert first != second and first.startswith(base) and second.startswith(base)


def test_scratch_folders_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_made", [])
    first, second = (scratch.shared_folder(spark, "a") for _ in range(2))
    for path in (first, second):
        spark.range(3).write.parquet(path)
    scratch.clear(spark, keep=[second])
    assert spark.read.parquet(second).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(first)
    scratch.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(second)


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: None),
        sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(session, "a")


def layout_in(spark, tmp_path, tag, **kwargs):
    layout = config.Layout(f"b_{tag}", f"s_{tag}", f"g_{tag}", location=str(tmp_path), **kwargs)
    tables.create_schemas(spark, layout)
    return layout


def test_write_table_replaces_schema_and_drop(spark, tmp_path):
    layout = layout_in(spark, tmp_path, "replace")
    name = layout.table("gold", "t")
    tables.write_table(spark.range(3).toDF("a"), name, layout)
    got = tables.write_table(spark.createDataFrame([("x", 1)], "b string, c int"), name, layout)
    assert tuples(got) == [("x", 1)] and got.columns == ["b", "c"]
    tables.drop_tables(spark, name, layout.table("gold", "never_there"))
    assert not spark.catalog.tableExists(name)


def test_bucketed_tables_join_without_shuffle(spark, tmp_path, gold):
    layout = layout_in(spark, tmp_path, "bucket", buckets=4)
    vectors = gold.select("review_id", F.array(F.lit(1.0)).alias("embedding"))
    a = tables.write_table(vectors, layout.table("silver", "v"), layout, bucket_by="review_id")
    b = tables.write_table(gold, layout.table("gold", "g"), layout, bucket_by="review_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = semantic.semantic_join(a, b)
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
        assert joined.count() == gold.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_failed_overwrite_leaves_the_old_table(spark, tmp_path):
    layout = layout_in(spark, tmp_path, "staged")
    name = layout.table("gold", "t")
    tables.write_table(spark.range(3).toDF("a"), name, layout)
    broken = spark.range(100).selectExpr("if(id = 99, raise_error('broken'), id) AS b")
    with pytest.raises(Exception, match="broken"):
        tables.write_table(broken, name, layout)
    assert sorted(tuples(spark.table(name))) == [(0,), (1,), (2,)]
    # a table may be replaced by rows read from itself
    tables.write_table(spark.table(name).selectExpr("a + 1 AS a"), name, layout)
    assert sorted(tuples(spark.table(name))) == [(1,), (2,), (3,)]
    names = {t.name for t in spark.catalog.listTables("g_staged")}
    assert names == {"t"}


def test_a_replacement_cut_off_between_its_renames_is_undone(spark, tmp_path):
    layout = layout_in(spark, tmp_path, "cut")
    name = layout.table("gold", "t")
    tables.write_table(spark.range(3).toDF("a"), name, layout)
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}{tables.BEFORE}")
    tables.restore(spark, name)
    assert spark.table(name).count() == 3
    tables.write_table(spark.range(1).toDF("a"), f"{name}{tables.BEFORE}", layout, mode="append")
    tables.restore(spark, name)
    assert spark.table(name).count() == 3 and not spark.catalog.tableExists(f"{name}{tables.BEFORE}")


class Asked:
    """A model that keeps count of what it is asked and may die."""

    def __init__(self, spark):
        self.texts = spark.sparkContext.accumulator(0)

    def job(self, tag, dies_at=None):
        texts = self.texts

        def make():
            def model(asked):
                if dies_at is not None and any(dies_at in t for t in asked):
                    raise RuntimeError("the model died")
                texts.add(len(asked))
                return [f"{tag}:{t}" for t in asked]
            return model

        return partial(models.apply_model, make_model=make, text="texto_completo", out="answer", out_type="string")


def reviews(spark, texts):
    return spark.createDataFrame(list(texts.items()), "review_id string, texto_completo string")


def answered(spark, layout, texts, job, version="", slices=4):
    got = answers.with_answers(
        reviews(spark, texts), job, "answer", layout.table("silver", "answers"), layout, version, slices=slices)
    return {r.review_id: r.answer for r in got.collect()}


def test_changed_new_and_gone_reviews(spark, tmp_path):
    layout, asked = layout_in(spark, tmp_path, "resume"), Asked(spark)
    first = answered(spark, layout, {"1": "a", "2": "b", "3": "a", "4": "d"}, asked.job("x"))
    assert first == {"1": "x:a", "2": "x:b", "3": "x:a", "4": "x:d"}
    assert asked.texts.value == 3  # a text that occurs twice is asked once
    second = answered(spark, layout, {"1": "a", "2": "changed", "5": "d", "6": ""}, asked.job("y"))
    assert second == {"1": "x:a", "2": "y:changed", "5": "x:d", "6": "y:"} and asked.texts.value == 5
    # another model or prompt asks everything again
    third = answered(spark, layout, {"1": "a", "2": "b"}, asked.job("z"), version="2")
    assert third == {"1": "z:a", "2": "z:b"} and asked.texts.value == 7
    left = answers.forget_unused(reviews(spark, {"1": "a"}), layout.table("silver", "answers"), layout, "2")
    assert left.count() == 1
    assert answered(spark, layout, {}, asked.job("w")) == {} and asked.texts.value == 7


def test_a_model_that_dies_is_asked_only_for_what_was_not_committed(spark, tmp_path):
    layout, asked = layout_in(spark, tmp_path, "dies"), Asked(spark)
    texts = {str(i): f"text {i}" for i in range(60)}
    journal = layout.table("silver", "answers")
    part = F.pmod(F.xxhash64(answers.request_key("texto_completo")), F.lit(4))
    parts = {r.review_id: r.p for r in reviews(spark, texts).select("review_id", part.alias("p")).collect()}
    last = next(t for t in texts if parts[t] == 3)
    with pytest.raises(Exception, match="the model died"):
        answered(spark, layout, texts, asked.job("x", dies_at=f"text {last}"))
    committed = spark.table(journal).count()
    assert committed == sum(p < 3 for p in parts.values()) and 0 < committed < 60
    before = asked.texts.value
    got = answered(spark, layout, texts, asked.job("y"))
    assert asked.texts.value - before == 60 - committed
    assert got == {i: f"{'x' if parts[i] < 3 else 'y'}:{t}" for i, t in texts.items()}
    assert not spark.catalog.tableExists(f"{journal}_pending")


def test_missing_texts_and_rows_left_twice(spark, tmp_path):
    layout = layout_in(spark, tmp_path, "odd")
    job = lambda df: df.withColumn("answer", F.coalesce("texto_completo", F.lit("none")))
    assert answered(spark, layout, {"1": None, "2": "", "3": "none"}, job) == {"1": "none", "2": "", "3": "none"}
    journal = layout.table("silver", "answers")
    doubled = spark.createDataFrame(spark.table(journal).collect(), spark.table(journal).schema)
    tables.write_table(doubled, journal, layout, mode="append")
    assert answered(spark, layout, {"1": None, "2": ""}, job) == {"1": "none", "2": ""}


def test_spread_only_where_splits_are_few(spark):
    few, many = spark.range(10).coalesce(1), spark.range(10).repartition(9)
    assert tables.spread(few, few).rdd.getNumPartitions() == 4
    assert tables.spread(many, many) is many


@pytest.mark.parametrize("split_files, buckets", [(False, None), (True, 2)])
def test_layers_end_to_end(spark, tmp_path, csv_file, split_files, buckets):
    asked = spark.sparkContext.accumulator(0)

    def make():
        def model(prompts):
            asked.add(len(prompts))
            return ['{"assunto":"Cor","sentimento":"negativo"}'] * len(prompts)
        return model

    used = layers.Models(
        embed=partial(infer.embed_hashed, dim=8),
        classify=partial(models.classify_with_model, make_model=make),
        summarise=infer.summarise_extractive,
    )
    layout = layout_in(spark, tmp_path / "db", f"run_{buckets}", buckets=buckets)
    run = partial(layers.run, spark, csv_file, used, layout, sample=2, partitions=2, split_files=split_files)
    run()
    assert asked.value == 2
    bronze = spark.table(layout.table("bronze", "reviews"))
    assert bronze.count() == 4 and bronze.columns[-2:] == ["_ingest_timestamp", "_source_file"]
    gold = spark.table(layout.table("gold", "reviews_classified"))
    assert tuples(gold.select("review_id", "assunto", "sentimento", "rating", "age"), "review_id") == [
        ("0", "cor", "negativo", 4, 33), ("2", "cor", "negativo", 2, None)]
    summary = spark.table(layout.table("gold", "assunto_resumo"))
    assert tuples(summary) == [("cor", 2, 3.0, 33.0, 100.0)]
    assert spark.table(layout.table("gold", "resumo_executivo")).first().qtd_negativos == 2
    assert spark.table(layout.table("gold", "sentimento_por_departamento")).count() == 1

    # a resumed run over a larger sample asks for the new review only
    run(sample=3, resume=True)
    assert asked.value == 3
    assert spark.table(layout.table("gold", "reviews_classified")).count() == 3
    names = {r._source_file for r in spark.table(layout.table("bronze", "reviews")).collect()}
    assert names == {"reviews.csv"}
    layers.drop_intermediates(spark, layout)
    assert not spark.catalog.tableExists(layout.table("silver", "reviews_limpo"))
    assert spark.catalog.tableExists(layout.table("silver", "reviews_embeddings"))
