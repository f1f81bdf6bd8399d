"""Queries that leave nothing out."""

from tidemark import catalogue

SF = "/root/testdata/sf0.01"


def test_whole_texts(spark):
    for name, cut, key in (("f6_searchable", 400, "page_id"), ("f5_normalize", 90, "doc_id")):
        whole = catalogue.queries()[name](spark, SF)
        value = next(c for c in whole.columns if c != key)
        assert whole.filter(f"length({value}) > {2 * cut}").count() > 0


def test_whole_orders(spark):
    for name, cut in (("o3_census_top", 25), ("o4_observation_order", 200), ("o5_community_order", 20), ("o8_by_rank", 100)):
        places = sorted(r.place for r in catalogue.queries()[name](spark, SF).select("place").collect())
        assert len(places) > cut and places == list(range(1, len(places) + 1)), name
