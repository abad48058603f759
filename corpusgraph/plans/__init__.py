"""Question-answering compositions and the registered check queries."""


def _load():
    from . import catalog, check_answer, check_extract, check_graph, check_maintain, check_pages, check_privacy, check_search, check_sources, check_upkeep  # noqa: F401

    return catalog


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
