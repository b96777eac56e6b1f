"""Rows whose ids are null or repeated, in the pipeline's stages."""

A, NEAR, B, C = "a b c d e f", "A B C D E F", "something else entirely here now", "one more text of a wholly different kind"


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_copies_are_judged_by_rows_not_ids(spark):
    import corpus_pipeline as p

    # a null id that copies nothing; a group of null ids; two texts under one id; a near copy under an id kept for another text
    rows = [(None, C), (None, "p q r s t u"), (None, "p q r s t u"), (1, A), (2, NEAR), (2, B), (None, "A b c d e f")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = p.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert rows_of(kept) == sorted([(None, C), (None, "p q r s t u"), (1, A), (2, B)], key=str)


def test_rows_of_one_id_are_decontaminated_each(spark):
    from footfall.llm import decontam

    item = " ".join(f"w{i}" for i in range(20))
    bad, clean = item, " ".join(f"w{i}" if i < 5 else f"x{i}" for i in range(20))  # one alignment, which only bad passes
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    for doc_id in (1, None):
        for order in ([bad, clean], [clean, bad]):
            df = spark.createDataFrame([(doc_id, t) for t in order], "doc_id long, text string").coalesce(1)
            assert [(r["doc_id"], r["item_id"], r["agreeing"]) for r in decontam.overlaps(df, bench).collect()] == [(doc_id, 7, 20)]
            assert rows_of(decontam.decontaminate(df, bench)) == [(doc_id, clean)]


def test_few_and_many_rows_go_alike(spark, monkeypatch):
    from footfall.llm import common

    df = spark.createDataFrame([(i % 3, f"t{i}", i) for i in range(20)], "doc_id long, text string, row_number int")
    for bound in (0, 100):
        monkeypatch.setattr(common, "FEW_ROWS", bound)
        rows = common.numbered(df, "rows")
        gone = rows.filter(f"{common.KEPT}.row_number % 4 = 1").select(common.ROW)
        left = common.without(rows, gone, "gone")
        assert left.columns == df.columns and sorted(r["row_number"] for r in left.collect()) == [i for i in range(20) if i % 4 != 1]
        assert common.without(rows, gone.limit(0), "gone").count() == 20
