"""The registered queries of the reference's operators, each with its SQL for an independent engine."""


def _modules():
    from tapeloom.plans import learning, market, orders, studies

    return (market, orders, studies, learning)


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLE_SQL.items()}
