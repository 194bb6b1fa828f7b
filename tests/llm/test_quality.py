from beatwire.llm.quality import (BASE_RULES, OWN_RULES, RULES, Facts, filter_quality, order_rules,
                                  passes, quality_report)

CLEAN = " ".join(f"word{i}" for i in range(60))


def test_repeat_words_by_position():
    assert Facts("a b c x a b c").n_repeat_words == 6
    assert Facts("a a a a").n_repeat_words == 4
    assert Facts("a b").n_repeat_words == 0
    assert Facts(None).n_repeat_words == 0


def test_facts():
    f = Facts("é# b c\n\n x \n x \n|")
    assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines) == (5, 8, 2, 1)


def test_order_does_not_change_the_verdict():
    for text in (CLEAN, "", "a " * 80, "## " + CLEAN, "\n".join(["same line here"] * 30)):
        f = Facts(text)
        assert passes(f, RULES) == passes(f, RULES[::-1])


def test_order_by_gain(docs_of):
    docs = docs_of(*[(i, "a " * 80) for i in range(20)])
    names = [r.name for r in order_rules(docs)]
    assert names[0] in ("word_length", "repeated_windows") and len(names) == len(RULES)


def test_report_cases(docs_of):
    docs = docs_of((1, CLEAN), (None, CLEAN), (2, None), (3, ""), (4, CLEAN), (4, CLEAN),
                   (5, "x " * 200_000), extra="kept n_words q")
    rows = quality_report(docs).collect()
    assert len(rows) == 7
    got = {r.doc_id: r for r in rows}
    assert got[1].kept and got[None].kept and got[4].kept
    assert not got[2].kept and got[2].n_words == 0 and got[2].base_failed
    assert got[5].n_repeat_words == 200_000 and got[5].base_failed


def test_filter_keeps_columns(docs_of):
    docs = docs_of((1, CLEAN), (2, None), extra="kept")
    out = filter_quality(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]


def test_empty_table(docs_of):
    empty = docs_of((1, "x")).limit(0)
    assert quality_report(empty).collect() == [] and filter_quality(empty).collect() == []
    assert [r.name for r in order_rules(empty)] == [r.name for r in BASE_RULES + OWN_RULES]


def test_query_equals_sql(spark, same_as_sql):
    same_as_sql(spark, "op8_quality_rules")
