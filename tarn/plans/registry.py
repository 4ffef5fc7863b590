"""Registry of the queries outside the llm subpackage."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    """Register a (spark, sf_dir) -> DataFrame function under ``name``, with its DuckDB SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


def FLAGSHIP(spark, sf_dir):
    return QUERIES["hybrid_rrf"](spark, sf_dir)


def _load():
    from . import guard, ingest, market, reports, retrieval, runs, streams  # noqa: F401  they register themselves


_load()
