"""A query that reads the FAQ and not the documents' texts joins the FAQ last: no other join shuffles it."""
import pytest
from helpers import SF_SMALL

from gazette.plans.fixtures import load_postings_raw, load_responses
from gazette.plans.registry import load_all


def carried_by_joins(df) -> list[str]:
    """The columns that go into each join from its left side, the last join first."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop(0)
        if node.nodeName() == "Join":
            found.append(node.left().output().mkString(" "))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("name", ["r7_faq_rows", "r8_faq_jsonld", "s3_read_responses", "s4_repair_truncated_json"])
def test_the_faq_is_shuffled_by_no_other_join(spark, name):
    assert not [c for c in carried_by_joins(load_all()[name][0](spark, SF_SMALL)) if "faq" in c]


def test_the_order_of_the_joins_changes_no_row(spark):
    one, other = (load_postings_raw(spark, SF_SMALL, last) for last in ("documents", "conversations"))
    assert one.columns == other.columns and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    assert load_responses(spark, SF_SMALL).count() == one.count()


def test_the_fixed_categories_are_broadcast(spark):
    plan = load_all()["v3_prepare_publish"][0](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0 and "hashpartitioning(category_name" not in plan and "hashpartitioning(_forced" not in plan


def test_each_json_document_is_made_from_what_it_reads(spark):
    docs = load_all()["s7_jsonld_documents"][0](spark, SF_SMALL)
    assert not [c for c in carried_by_joins(docs) if "faq" in c or "doc_text" in c]


def test_answers_meet_their_pages_without_their_faq(spark):
    from gazette.plans.enrich import enrich_batch, page_side
    facts = spark.createDataFrame([(1, "https://a.in/x", "text", [], "", "job")], "page_id long, url string, text string, "
                                  "official_links array<struct<title:string,url:string>>, featured_image string, detected_type string")
    answers = spark.createDataFrame([(5, 1, '{"title": "T", "faq": [{"question": "q", "answer": "a"}]}')], "response_id long, page_id long, body string")
    posts, _ = enrich_batch(answers, facts)
    counted = posts.select("post_id", "title", "faq_count")
    assert not [c for c in carried_by_joins(counted) if "faq#" in c.replace("_n_faq", "")]
    assert [tuple(r) for r in counted.collect()] == [(5, "T", 1)]
    kept, _ = enrich_batch(answers, page_side(facts))
    assert kept.columns == posts.columns and kept.exceptAll(posts).isEmpty()
