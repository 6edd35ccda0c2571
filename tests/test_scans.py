"""Rules over texts read their input once, however many forms and rules they tell."""

from findlake.operators import documents, rules


def scans_of(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")


def lines_of(spark):
    docs = spark.createDataFrame([(1, "see ![a](e.png) and [b](c.md)\n[x] <https://h>\n[X]: d.md\n"), (2, "[![i](j.png)](k.md)\n`[n](o)`\n")], "doc_id long, text string")
    return documents.explode_lines(docs, fences=True)


def test_references_read_their_lines_once(spark):
    found = documents.references(lines_of(spark))
    assert scans_of(found) == 1
    assert sorted((r.doc_id, r.line, r.ord, r.kind, r.ref_path) for r in found.collect()) == [
        (1, 1, 0, "embed", "e.png"), (1, 1, 1, "cross_reference", "c.md"), (1, 2, 0, "cross_reference", "d.md"), (1, 2, 1, "cross_reference", "https://h"), (2, 1, 0, "cross_reference", "k.md"), (2, 1, 1, "embed", "j.png"),
    ]


def test_reference_rules_read_their_lines_once(spark):
    files = spark.range(1).selectExpr("'e.png' AS ref_path")
    found = documents.reference_rules(documents.references(lines_of(spark)), files)
    assert scans_of(found) == 1
    assert sorted((r.rule_id, r.doc_id, r.message) for r in found.collect()) == [
        ("REF-001", 1, "e.png"), ("REF-001", 2, "j.png"), ("REF-002", 2, "j.png"), ("REF-006", 1, "c.md"), ("REF-006", 1, "d.md"), ("REF-006", 1, "https://h"), ("REF-006", 2, "k.md"),
    ]


def test_link_schemes_and_image_paths_read_their_lines_once(spark):
    pages = spark.range(1, 3).selectExpr("id AS doc_id", "'methodology/library/b/p.md' AS path")
    assert scans_of(documents.link_scheme_rule(documents.references(lines_of(spark)))) == 1
    assert scans_of(rules.image_path_rule(lines_of(spark), pages)) == 1


def test_line_hygiene_reads_texts_once(spark):
    docs = spark.createDataFrame([(1, "a\r\nb \n"), (2, ""), (3, "a"), (4, "a\n\n"), (5, None), (6, "a　\nb\r")], "doc_id long, text string")
    found = documents.line_hygiene(docs)
    assert scans_of(found) == 1
    assert sorted((r.doc_id, r.rule_id, r.line or 0) for r in found.collect()) == [(1, "WIKI-009", 0), (1, "WIKI-010", 2), (3, "WIKI-011", 0), (4, "WIKI-011", 0), (6, "WIKI-009", 0), (6, "WIKI-010", 1), (6, "WIKI-010", 2), (6, "WIKI-011", 0)]
