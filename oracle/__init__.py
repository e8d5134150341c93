"""SQL statements that the Spark queries are checked against, one module per area."""


def plain_counts(sql: str) -> str:
    """``count_if(x)`` as a filtered count, whose type is a plain 64-bit integer."""
    mark = "count_if("
    while mark in sql:
        start = sql.index(mark)
        at, depth = start + len(mark), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        sql = f"{sql[:start]}count(*) filter (where {sql[start + len(mark):at - 1]}){sql[at:]}"
    return sql
