"""Entities and papers through their life: validation, proof of delivery, waybills, merged addresses, invoices as XML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.numeric import half_up
from haulspark.operators.grouped import Rows, walk_groups


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def _found(*pairs: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for name, when in pairs]), lambda x: x.isNotNull())


def client_errors(name: Column, vat_id: Column, email: Column, phone: Column) -> Column:
    """What is wrong with a client's fields; optional ones may be blank."""
    digits = F.length(F.regexp_replace(phone, "[^0-9]", ""))
    return _found(
        ("name_missing", _blank(name)), ("name_short", ~_blank(name) & (F.length(F.trim(name)) < 2)),
        ("vat_id_invalid", ~_blank(vat_id) & (~F.trim(vat_id).rlike("^[A-Za-z0-9 ]{2,20}$") | ~vat_id.rlike("[0-9]"))),
        ("email_invalid", (email != "") & ~email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$")),
        ("phone_invalid", ~_blank(phone) & (~F.trim(phone).rlike(r"^[0-9+()./\s-]+$") | (digits < 7) | (digits > 15))),
    )


def proof_of_delivery(rows: DataFrame) -> DataFrame:
    """``pod_error`` and the ``stop_status`` of proofs (outcome, recipient_name, signature_url, refusal_reason).

    A delivery needs a recipient and a signature, a refusal its reason; a refused stop has failed, others are done.
    """
    c = F.col
    error = (
        F.when(~F.coalesce(F.trim("outcome"), F.lit("")).isin("livrat", "refuzat", "partial"), "outcome_unknown")
        .when((c("outcome") == "livrat") & _blank(c("recipient_name")), "recipient_missing")
        .when((c("outcome") == "refuzat") & _blank(c("refusal_reason")), "reason_missing")
        .when((c("outcome") == "livrat") & _blank(c("signature_url")), "signature_missing")
    )
    return rows.withColumn("pod_error", error).withColumn("stop_status", F.when(F.col("pod_error").isNull(), F.when(c("outcome") == "refuzat", "esuat").otherwise("finalizat")))


def waybill_gaps(rows: DataFrame, required: Mapping[str, Sequence[str]]) -> DataFrame:
    """``missing_<stage>`` (boxes still blank) of each stage, and ``filled`` of all boxes."""
    stages = {f"missing_{stage}": _found(*[(b, _blank(F.col(b))) for b in boxes]) for stage, boxes in required.items()}
    every = [b for boxes in required.values() for b in boxes]
    filled = sum((~_blank(F.col(b))).cast("int") for b in every)
    return rows.withColumns({**stages, "filled": filled})


def merged_into(rows: DataFrame, id_col: str, into: str, hops: int = 5) -> DataFrame:
    """``final_id``: where the chain of merges from each row ends, followed ``hops`` times at most; loops end there too.

    Each hop joins the same small pair of columns, so the plan holds ``hops`` joins and no driver loop over rows.
    """
    pairs = rows.select(F.col(id_col).alias("_from"), F.col(into).alias("_to")).where("_to is not null")
    out = rows.withColumn("final_id", F.col(id_col))
    for _ in range(hops):
        out = out.join(pairs, F.col("final_id") == F.col("_from"), "left").withColumn("final_id", F.coalesce("_to", "final_id")).drop("_from", "_to")
    return out


def unique_names(rows: DataFrame, archive: str, name: str, order: Sequence[str]) -> DataFrame:
    """``unique_name``: file names made unique within their archive, in ``order``: ``stem-1.end``, ``stem-2.end`` and on until one is free.

    Folders of a name count with it. An archive is what a person downloads, so that its names fit in one walk.
    """
    names = rows.columns

    def walk(_: object, columns: Rows) -> list[tuple]:
        used, following, out = set(), {}, []
        for i, told in enumerate(columns[name]):
            folder, slash, base = str(told or "file").replace("\\", "/").rpartition("/")
            base = base or "file"
            stem, dot, end = base.rpartition(".")
            if not stem:
                stem, dot, end = base, "", ""
            now, n = f"{folder}{slash}{base}", following.get((folder, base), 1)
            while now in used:
                now, n = f"{folder}{slash}{stem}-{n}{dot}{end}", n + 1
            following[folder, base] = n
            used.add(now)
            out.append((*(columns[c][i] for c in names), now))
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return walk_groups(rows, archive, order, walk, f"{schema}, unique_name string")


def _xml(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def invoice_xml(lines: DataFrame) -> DataFrame:
    """``invoice_id, xml`` of lines (invoice_id, seq, label, amount, vat_pct, client): one document an invoice."""
    money = lambda c: F.format_string("%.2f", c)
    line = F.concat(F.lit("<Line><Id>"), F.col("seq").cast("string"), F.lit("</Id><Name>"), _xml(F.col("label")), F.lit("</Name><Amount>"), money(F.col("amount")), F.lit("</Amount></Line>"))
    packed = lines.groupBy("invoice_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("x")))), lambda s: s["x"]), "").alias("body"),
        F.sum(F.col("amount").cast("decimal(28,2)")).cast("double").alias("net"), F.first("client").alias("client"), F.first("vat_pct").alias("vat_pct"),
    )
    vat = half_up(F.col("net") * F.col("vat_pct") / 100, 2)
    xml = F.concat(
        F.lit("<Invoice><ID>"), F.col("invoice_id").cast("string"), F.lit("</ID><Customer>"), _xml(F.col("client")), F.lit("</Customer>"), F.col("body"),
        F.lit("<Net>"), money(F.col("net")), F.lit("</Net><Tax>"), money(vat), F.lit("</Tax><Total>"), money(F.col("net") + vat), F.lit("</Total></Invoice>"),
    )
    return packed.select("invoice_id", xml.alias("xml"))


def join_rows_of_pages(items: DataFrame, same_line: float = 3.0, gap: float = 6.0) -> DataFrame:
    """Text lines ``page_id, line_no, text`` of positioned items (page_id, x, y, width, text), top to bottom.

    An item joins the line whose first item is within ``same_line`` of its height; a wide gap puts a tab between.
    """

    def walk(key: object, rows: Rows) -> list[tuple]:
        lines: list[tuple[float, list[int]]] = []
        for i in range(len(rows["x"])):
            if lines and abs(lines[-1][0] - rows["y"][i]) <= same_line:
                lines[-1][1].append(i)
            else:
                lines.append((rows["y"][i], [i]))
        out = []
        for n, (_, members) in enumerate(lines, 1):
            text, end = "", None
            for i in sorted(members, key=lambda i: (rows["x"][i], -rows["y"][i], rows["text"][i])):
                text += ("" if end is None else "\t" if rows["x"][i] - end > gap else " ") + rows["text"][i]
                end = rows["x"][i] + rows["width"][i]
            out.append((key, n, text))
        return out

    return walk_groups(items.withColumn("_down", -F.col("y")), "page_id", ["_down", "x"], walk, "page_id long, line_no int, text string")


def split_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, part``: pages (doc_id, page_no, keys) put in one part as long as they share a key with it.

    A page without keys stays with the part before it. Where page and part both have numbers of their own, orders
    (keys that begin with ``TPO-``) do not hold them together. Fewer than two keys in all is no split (part 1).
    """

    def walk(key: object, rows: Rows) -> list[tuple]:
        own = lambda keys: {k for k in keys if not k.startswith("TPO-")}
        part, held, parts, every = 0, set(), [], set()
        for keys in rows["keys"]:
            now = set(keys) if keys is not None else set()
            every |= now
            shared = own(now) & held if own(now) and own(held) else now & held
            if not parts or (now and not shared):
                part, held = part + 1, set()
            held |= now
            parts.append(part)
        if len(every) < 2:
            parts = [1] * len(parts)
        return [(key, int(n), p) for n, p in zip(rows["page_no"], parts, strict=True)]

    return walk_groups(pages, "doc_id", ["page_no"], walk, "doc_id long, page_no int, part int")
