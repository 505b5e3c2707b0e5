"""Errors with the numeric codes that clients of the document language know."""

from __future__ import annotations

MESSAGES = {
    9016: "$bit needs an and, or or xor operand",
    10138: "$bit applies to integers only",
    10139: "$bit operands are integers",
    10140: "$inc applies to numbers only",
    10141: "$push applies to arrays only",
    10142: "$pull applies to arrays only",
    10143: "$pop applies to arrays only",
    10145: "a parent of the path is a scalar",
    10147: "update operators and plain fields do not mix",
    10148: "unknown update operator",
    10149: "invalid operator in an upsert selector",
    10150: "a path is updated twice",
    10151: "a path and its prefix are both updated",
    10158: "several documents cannot be replaced at once",
    10159: "malformed logical operator in an upsert selector",
    10348: "an array has no field of this name",
    11000: "duplicate key",
    11002: "option not supported",
    12591: "$addToSet applies to arrays only",
    13494: "the target of $rename is a string",
    15896: "field names do not start with $",
    15899: "either remove or update is needed",
    16836: "the _id of a document cannot change",
    16837: "$mul applies to numbers only",
    16840: "the operand is not a number",
    17288: "projection not supported",
    20000: "invalid operand",
    20002: "sort is not supported here",
    20005: "a unique index is not built in the background",
    20010: "the _id of a document cannot change",
    26840: "an update operator needs fields",
    29966: "an error was asked for",
    29967: "an index needs a name",
    29969: "text indexes are not supported",
    29976: "the source collection does not exist",
    29977: "the target collection exists",
    29978: "source and target are the same",
    29982: "an index over _id has no other field",
    29985: "timestamps of this kind are not supported",
    29990: "index directions do not mix",
    29992: "a document has more than 1000 entries in a compound index",
    29991: "an index direction is 1 or -1",
    29993: "another index has this name",
    29997: "unknown operator",
    29999: "an _id is not an array",
}


class DocumentError(Exception):
    """An error of the document language; ``code`` is its number."""

    def __init__(self, code: int, detail: str = ""):
        self.code = code
        super().__init__(f"{code}: {MESSAGES.get(code, 'error')}" + (f" ({detail})" if detail else ""))
