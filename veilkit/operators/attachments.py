"""Attachments: what kind of file it is, its text if it is one, or why it could not be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.values import in_list


def classify(df: DataFrame) -> DataFrame:
    """Adds kind (pdf, image, text, other) from media_type, name and the first bytes of content."""
    ends = " OR ".join(f"endswith(lower(name), '{e}')" for e in fixed.TEXT_EXTENSIONS)
    return df.withColumn("kind", F.expr(
        "CASE WHEN media_type = 'application/pdf' OR endswith(lower(name), '.pdf') OR "
        "substring(coalesce(content, X''), 1, 5) = encode('%PDF-', 'UTF-8') THEN 'pdf' "
        "WHEN startswith(media_type, 'image/') THEN 'image' "
        f"WHEN startswith(media_type, 'text/') OR {in_list('media_type', fixed.TEXT_ATTACHMENT_TYPES)} OR {ends} THEN 'text' "
        "ELSE 'other' END"))


def scan_texts(df: DataFrame, request: str, order: str, *, max_bytes: int | None = None, max_count: int | None = None) -> DataFrame:
    """Adds text (decoded text files) and reason (why a file could not be read). All files are read; a caller's
    limits mark what they leave out: files over the size, and those beyond the first `max_count` of a request.
    Equal contents share a hash so a caller can scan each once."""
    decoded = "try_validate_utf8(cast(content AS string))"
    late, large = "", ""
    rows = classify(df)
    if max_count is not None:
        # the last place read, from slim rows: file contents are never sorted
        slim = df.select(F.col(request).alias("_request"), F.col(order).alias("_last"))
        rank = F.row_number().over(Window.partitionBy("_request").orderBy("_last"))
        last = slim.withColumn("_rank", rank).filter(F.col("_rank") <= max_count).filter(F.col("_rank") == max_count).drop("_rank")
        rows = rows.join(last, F.col(request) == F.col("_request"), "left")
        late = f"WHEN `{order}` > _last THEN 'ek sayısı sınırı ({max_count})' "
    if max_bytes is not None:
        large = f"WHEN octet_length(content) > {max_bytes} THEN concat('boyut sınırı aşıldı (', octet_length(content), ' bayt)') "
    return (
        rows.withColumn("reason", F.expr(
            f"CASE {late}WHEN content IS NULL THEN coalesce(remote_reason, 'uzak adres') {large}"
            f"WHEN kind = 'text' AND {decoded} IS NULL THEN 'metin dosyası UTF-8 değil' "
            "WHEN kind = 'text' THEN NULL "
            "ELSE concat('desteklenmeyen tür (', if(media_type = '', 'bilinmiyor', media_type), ')') END"))
        .withColumn("text", F.expr(f"if(kind = 'text' AND reason IS NULL, {decoded}, NULL)"))
        .withColumn("content_sha", F.expr("sha2(content, 256)"))
        .drop("_request", "_last")
    )


def unscannable_lists(scanned: DataFrame, request: str) -> DataFrame:
    """(request, unscannable): 'name: reason' of the files that could not be read."""
    return (scanned.filter("reason IS NOT NULL").groupBy(request)
            .agg(F.array_sort(F.collect_set(F.concat("name", F.lit(": "), "reason"))).alias("unscannable")))
