from slovomer.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"


def test_texts_of_the_corpora(spark):
    for name, id_col, table in (("p2_primer_repaired", "rec_id", "primer_records"), ("p2_works_repaired", "file", "works_records")):
        got = Q.QUERIES[name](spark, FOLDER)
        assert got.columns == [id_col, "defects", "repaired"]
        rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
        assert got.join(rows, id_col, "left_anti").count() == 0


def test_forms_of_the_corpora(spark):
    for name, table, fields in (("p5_primer_forms", "primer_records", 4), ("p5_works_forms", "works_records", 5)):
        got = Q.QUERIES[name](spark, FOLDER)
        assert got.count() == fields * spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
        assert got.where("field = 'type' and form is not null").count() > 0
