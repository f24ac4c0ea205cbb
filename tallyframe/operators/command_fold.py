"""Requests that share rows, in order of ``seq``: one pass over the components of their conflict graph.

Splits, merges and the voids, restores and notes of the same rows must see each other's effects. Two requests
conflict when they name or make the same row; rows and requests form a graph, and requests of different components
never meet. Components are labelled by a few windows over (request, row) pairs (:func:`components`). Then all steps
stream past, sorted by component and ``seq``, each with the ledger row it names, and a component's rows are kept in
hand while its steps are taken one by one (:func:`folded`). A task holds the rows of one component, not its steps.

The order of requests of one component is a matter of meaning, so a component is one task's work however large.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import timedelta
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.periods import clamp_start_day
from ..session import ship_package

SPLIT_RESULT = "request_id string, txn_id bigint, ok boolean, error string, parts int"
MERGE_RESULT = "request_id string, ok boolean, error string, offset boolean, merged_id bigint, net double, month string, count bigint"
RESULT = ("request_id string, txn_id bigint, ok boolean, error string, parts int, offset boolean, merged_id bigint, net double, "
          "month string, count bigint")
STEP = ("request_id", "seq", "op", "row_id", "pos", "payload", "amounts", "category", "note", "month", "expected_operation")
CENT = Decimal("0.01")


def components(pairs: DataFrame, rounds: int = 2) -> DataFrame:
    """(id, component) of every row in ``pairs`` (request_id, id): rows that chains of requests join have one component.

    Labels spread through requests and rows by windows, ``rounds`` times before each look at whether any changed; a
    star of requests around a row is done in the first pass, a chain needs as many rounds as half its length.
    """
    by_request, by_row = Window.partitionBy("request_id"), Window.partitionBy("id")
    labels = pairs.select("request_id", "id", F.col("id").alias("component"))
    while True:
        for _ in range(rounds):
            labels = labels.withColumn("before", F.min("component").over(by_request))
            labels = labels.withColumn("component", F.min("before").over(by_row))
        labels = labels.withColumn("open", F.col("component") != F.col("before")).select("request_id", "id", "component", "open").checkpoint()
        if labels.filter("open").isEmpty():
            return labels.groupBy("id").agg(F.min("component").alias("component"))


def hash_id(kind: str, *parts) -> int:
    """The same id as :func:`tallyframe.operators.commands._hash_id`."""
    return int(hashlib.md5(":".join([kind, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def _cents(x: Decimal) -> Decimal:
    return x.quantize(CENT, ROUND_HALF_UP)


class Fold:
    """The rows of one component, as the steps taken so far have left them."""

    def __init__(self, columns: list[str], start_day: int):
        self.columns, self.start_day = columns, clamp_start_day(start_day)
        self.rows: dict[int, dict] = {}
        self.named: set[int] = set()  # rows of the ledger; the others are made here

    def period(self, t) -> str:
        return (t - timedelta(days=self.start_day - 1)).strftime("%Y-%m")

    def edit(self, op: str, row_id: int, payload: str | None) -> None:
        row = self.rows.get(row_id)
        if row is None:
            return
        if op in ("void", "restore"):
            row["voided"] = op == "void"
        elif payload is not None:
            row["note"] = payload

    def split(self, request_id: str, row_id: int, amounts: list) -> dict:
        parts, row = [_cents(a) for a in amounts or []], self.rows.get(row_id)
        error = None
        if row is None or row["amount"] is None:
            error = "not found"
        elif row["voided"]:
            error = "voided"
        elif len(parts) < 2:
            error = "need at least two parts"
        elif abs(sum(parts) - _cents(row["amount"])) > CENT:
            error = "parts do not sum"
        if error is None:
            for pos, amount in enumerate(parts):
                child = dict.fromkeys(self.columns) | {c: row[c] for c in (
                    "source_msg_id", "card_last4", "card_type", "txn_time", "currency", "direction", "action", "merchant_raw",
                    "merchant_key", "channel")}
                child |= {"id": hash_id("split", request_id, pos), "amount": amount, "status": "pending", "voided": False,
                          "fingerprint": None if row["fingerprint"] is None else f"{row['fingerprint']}#s{pos}",
                          "note": f"{K.NOTE_SPLIT_FROM}{row_id}"}
                self.rows[child["id"]] = child
            row["voided"], row["note"] = True, (row["note"] or "") + K.NOTE_SPLIT
        return {"request_id": request_id, "txn_id": row_id, "ok": error is None, "error": error, "parts": len(parts)}

    def merge(self, request_id: str, members: list[tuple[int, int]], head: dict) -> dict:
        """``members``: (position, row id), repeats kept."""
        live = [(pos, self.rows[i]) for pos, i in members if i in self.rows and not self.rows[i]["voided"]]
        net = _cents(sum((r["amount"] or Decimal(0) for _, r in live), Decimal(0)))
        out = {"request_id": request_id, "ok": False, "offset": False, "count": len(live)}
        if len(live) < 2:
            return out | {"error": "need at least two live transactions"}
        if head["expected_operation"] == "offset" and abs(net) >= CENT:
            return out | {"error": "net is not zero: cannot offset"}
        offset = abs(net) < CENT
        out |= {"ok": True, "offset": offset, "net": float(net)}
        into = None
        if not offset:
            timed = [x for x in live if x[1]["txn_time"] is not None]
            first = min(timed, key=lambda x: (x[1]["txn_time"], x[0]), default=live[0])[1]
            into = hash_id("merge", request_id)
            month = head["month"] or min((self.period(r["txn_time"]) for _, r in timed), default=None)
            known = head["category"] is not None
            self.rows[into] = dict.fromkeys(self.columns) | {c: first[c] for c in (
                "source_msg_id", "card_last4", "card_type", "txn_time", "currency", "merchant_raw", "merchant_key", "channel")} | {
                "id": into, "fingerprint": f"merge:{request_id}", "amount": net, "direction": "refund" if net < 0 else "expense",
                "action": K.MERGE_ACTION, "category": head["category"], "category_src": K.CATEGORY_SRC_MANUAL if known else None,
                "status": "confirmed" if known else "pending", "voided": False, "effective_month": month, "note": head["note"]}
            out |= {"merged_id": into, "month": month}
        for i in {i for _, i in members}:
            row = self.rows.get(i)
            if row is not None and not row["voided"]:
                row["voided"], row["note"] = True, (row["note"] or "") + (K.NOTE_OFFSET if offset else K.NOTE_MERGED)
                row["merged_into"] = row["merged_into"] if offset else into
        return out


def _steps(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[dict, tuple | None]]:
    """(step, values of the ledger row it names or None): column by column, so that a row becomes a dict only where the
    fold takes it up."""
    names = [n for n in batch.schema.names if n != "row"]
    row = batch.column("row")
    values = zip(*[row.field(c).to_pylist() for c in columns])
    for step, there, found in zip(zip(*[batch.column(n).to_pylist() for n in names]), row.is_valid().to_pylist(), values):
        yield dict(zip(names, step)), found if there else None


def _struct(rows: list[dict | None], kind: pa.StructType) -> pa.StructArray:
    """An array of these dicts, made field by field."""
    fields = [kind.field(i) for i in range(kind.num_fields)]
    arrays = [pa.array([None if r is None else r.get(f.name) for r in rows], f.type) for f in fields]
    return pa.StructArray.from_arrays(arrays, fields=fields, mask=pa.array([r is None for r in rows], pa.bool_()))


def _folder(columns: list[str], schema: pa.Schema, start_day: int):
    def told(out: list[tuple]) -> pa.RecordBatch:
        kinds, rows, results = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(kinds, schema.field("kind").type), _struct(rows, schema.field("row").type),
                                           _struct(results, schema.field("result").type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []  # (kind, row, result)
        component, fold, request = None, None, []

        def take() -> None:
            """The request whose rows have all come in."""
            if not request:
                return
            head = request[0]
            if head["op"] == "split":
                out.append(("split", None, fold.split(head["request_id"], head["row_id"], head["amounts"])))
            elif head["op"] == "merge":
                members = [(s["pos"], s["row_id"]) for s in request]
                out.append(("merge", None, fold.merge(head["request_id"], members, head)))
            else:
                fold.edit(head["op"], head["row_id"], head["payload"])
            request.clear()

        def finish() -> None:
            if fold is not None:
                take()
                out.extend(("row" if i in fold.named else "made", r, None) for i, r in fold.rows.items())

        for batch in batches:
            for step, row in _steps(batch, columns):
                if step["component"] != component:
                    finish()
                    component, fold = step["component"], Fold(columns, start_day)
                if request and (step["op"] != "merge" or request[0]["op"] != "merge" or request[0]["request_id"] != step["request_id"]):
                    take()
                if row is not None and step["row_id"] not in fold.rows:
                    fold.rows[step["row_id"]] = dict(zip(columns, row))
                    fold.named.add(step["row_id"])
                request.append(step)
            if out:
                yield told(out)
                out.clear()
        finish()
        if out:
            yield told(out)

    return run


def folded(ledger: DataFrame, steps: DataFrame, pairs: DataFrame, start_day: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, split results, merge results) after all steps, cut from their lineage in the shared folder.

    ``steps`` (columns ``STEP``, one row for each row a request names) and ``pairs`` (request_id, id), the rows they
    name or make. ``rows``: every ledger row that a step names, as it is now, and the rows ``made``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    ship_package(ledger.sparkSession)
    of = components(pairs)
    named = ledger.join(of.select("id"), "id", "left_semi").select("id", F.struct(*ledger.columns).alias("row"))
    at = steps.select(*STEP).join(of, F.col("row_id") == F.col("id")).drop("id").join(named, F.col("row_id") == named["id"], "left").drop("id")
    at = at.repartition("component").sortWithinPartitions("component", "seq", "request_id", "op", "pos")
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("row", ledger.select(F.struct(*ledger.columns).alias("row")).schema["row"].dataType),
                           T.StructField("result", T.StructType.fromDDL(RESULT))])
    told = at.mapInArrow(_folder(ledger.columns, to_arrow_schema(schema), start_day), schema).checkpoint()
    result = lambda kind, ddl: told.filter(F.col("kind") == kind).select(*[f"result.{c.split()[0]}" for c in ddl.split(", ")])
    rows = told.filter(F.col("kind").isin("row", "made")).select("row.*", (F.col("kind") == "made").alias("made"))
    return rows, result("split", SPLIT_RESULT), result("merge", MERGE_RESULT)
