"""Errors of the query language. Each says where the query went wrong and what this engine offers in its place."""

from __future__ import annotations

from enum import Enum


class QueryError(ValueError):
    """Any error of the query language."""


class ParseError(QueryError):
    def __init__(self, msg: str, span: tuple[int, int]):
        self.msg, self.span = msg, span
        super().__init__(f"cannot read the query at character {span[0]}: {msg}")


class ExecuteError(QueryError):
    def __init__(self, msg: str):
        self.msg = msg
        super().__init__(f"cannot run the query: {msg}")


class StorageError(QueryError):
    def __init__(self, msg: str):
        super().__init__(f"cannot use the store: {msg}; `python -m callscape index --rebuild` writes it anew")


class Clause(Enum):
    """What the language leaves out, and where this engine has it."""

    WITH = "WITH: the frame that a query compiles to can be transformed further with DataFrame operations"
    UNWIND = "UNWIND: put the values in a frame and join it with the query's"
    MERGE = "MERGE: queries read the graph, `refresh` is what writes it"
    CREATE = "CREATE: nodes come from source files by way of `refresh`"
    DELETE = "DELETE: nodes go when their files do, at the next `refresh`"
    SET = "SET: properties follow from source files"
    REMOVE = "REMOVE: properties follow from source files"
    VARIABLE_LENGTH = "paths of variable length: `trace_path` walks up to five steps from a name"
    OPTIONAL = "OPTIONAL MATCH: join two queries' frames with a left join"
    AGGREGATION = "aggregates: group the frame that a query compiles to"
    FUNCTION = "functions: apply them to the columns of the frame that a query compiles to"
    MULTIPLE_MATCH = "a second MATCH: write one pattern of up to three hops, or join two queries' frames"
    PATH_VARIABLE = "variables for whole paths: name the nodes and edges that are wanted"


class UnsupportedError(QueryError):
    def __init__(self, clause: Clause):
        self.clause = clause
        super().__init__(f"not in this query language: {clause.value}")
