"""Corpus manifests: identity keys, corpus versions, triage, routing and extraction outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import normalize_type

#: Formats and document types that are discarded, and why.
DISCARDED_FORMATS = {
    "jpeg": "imagem, sem texto extraível",
    "jpg": "imagem, sem texto extraível",
    "jfif": "imagem, sem texto extraível",
    "png": "imagem, sem texto extraível",
    "mp4": "vídeo, sem rota de extração de texto",
    "mp3": "áudio, sem rota de extração de texto",
}
DISCARDED_TYPES = {
    "recibo": "recibo de protocolo/entrega, sem conteúdo de mérito",
    "recibo registrado": "recibo de protocolo/entrega, sem conteúdo de mérito",
    "recibo do": "recibo de protocolo/entrega, sem conteúdo de mérito",
    "recibo (s)": "recibo de protocolo/entrega, sem conteúdo de mérito",
    "procuração": "instrumento de representação, sem conteúdo de mérito",
    "requerimento de distribuição de processo": "trâmite administrativo interno (distribuição), sem conteúdo de mérito",
    "despacho de distribuição de processo": "trâmite administrativo interno (distribuição), sem conteúdo de mérito",
    "requerimento de inclusão em pauta": "trâmite administrativo interno (agenda de pauta), sem conteúdo de mérito",
    "despacho de mero expediente": "despacho de mero expediente: ato processual sem conteúdo decisório",
    "formulário": "formulário de cadastro/entrada, sem conteúdo de mérito",
    "documentação societária": 'documentação de constituição societária ("contrato social" e similares) — distinto de "Contrato" (ex.: CUST), nunca descartado',
    "termo de cancelamento de documento": "termo administrativo de cancelamento de documento, sem conteúdo de mérito",
    "confirmação": "confirmação de recebimento, sem conteúdo de mérito",
    "confirmação do recebimento de notificação": "confirmação de recebimento, sem conteúdo de mérito",
    "lista de presença": "lista de presença/registro de comparecimento, sem conteúdo de mérito",
    "cnpj": "documento de identificação de pessoa jurídica, sem conteúdo de mérito",
    "cnh": "documento de identificação pessoal, sem conteúdo de mérito",
}


def _lookup(value: Column, entries: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in entries.items() for x in kv]), value)


def triage(rows: DataFrame, kind: str = "tipo_documento", form: str = "formato", formats: dict[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Adds descartado and motivo_descarte; the format is looked at before the type."""
    by_format = _lookup(F.lower(F.col(form)), DISCARDED_FORMATS if formats is None else formats)
    by_type = _lookup(F.lower(normalize_type(F.col(kind))), DISCARDED_TYPES if types is None else types)
    reason = F.coalesce(by_format, by_type)
    return rows.withColumns({"motivo_descarte": reason, "descartado": reason.isNotNull()})


def _json_text(s: Column) -> Column:
    """A string as JSON in printable ASCII."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        far = n - 0x10000
        pair = F.concat(unit(F.shiftright(far, 10) + 0xD800), unit(far.bitwiseAND(0x3FF) + 0xDC00))
        out = F.when(n > 0xFFFF, pair).when((n < 32) | (n > 126), unit(n)).otherwise(c)
        for plain, escaped in (("\f", "\\f"), ("\b", "\\b"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n"), ("\\", "\\\\"), ('"', '\\"')):
            out = F.when(c == plain, escaped).otherwise(out)
        return out

    return F.when(s == "", '""').otherwise(F.concat(F.lit('"'), F.array_join(F.transform(F.split(s, ""), one), ""), F.lit('"')))


def canonical_key(*columns: Column) -> Column:
    """A JSON list of strings and whole numbers as json.dumps writes it (blanks behind commas, escapes beyond ASCII)."""
    text = [F.coalesce(F.when(F.typeof(c) == "string", _json_text(c.cast("string"))).otherwise(c.cast("string")), F.lit("null")) for c in columns]
    return F.concat(F.lit("["), F.concat_ws(", ", *text), F.lit("]"))


def corpus_version(keys: DataFrame, key: str = "key") -> DataFrame:
    """One digest of a set of keys, whatever their order or partitioning.

    A tree of hashes: keys are hashed, digests sorted and hashed within each of 4096 groups by their first three digits, and the groups'
    digests hashed in order. No task holds more than a 4096th of the keys.
    """
    d = keys.select(F.sha2(F.col(key), 256).alias("h"))
    groups = d.groupBy(F.substring("h", 1, 3).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "\n"), 256).alias("corpus_version"), F.count(F.lit(1)).alias("groups"))


def listed_version(keys: DataFrame, key: str = "key", most: int = 1_000_000) -> str:
    """The digest of all sorted keys as one text, for manifests of at most ``most`` rows."""
    import hashlib

    if keys.count() > most:
        raise ValueError(f"more than {most} keys: use corpus_version")
    digest = hashlib.sha256()
    for i, r in enumerate(keys.select(key).orderBy(key).toLocalIterator()):
        digest.update((("\n" if i else "") + r[0]).encode())
    return digest.hexdigest()


def outcome(rows: DataFrame, cache: DataFrame, routes: dict[str, str], version: str) -> DataFrame:
    """rows: sha256, formato, has_file, descartado. What extraction does with each: discarded, pending (no file, no route), cached or to
    extract. cache: sha256, extractor_version."""
    route = _lookup(F.lower(F.col("formato")), routes)
    known = cache.where(F.col("extractor_version") == version).select("sha256", F.lit(True).alias("hit")).distinct()
    out = rows.withColumn("route", route).join(known, "sha256", "left")
    status = (
        F.when(F.col("descartado"), "descartado")
        .when(~F.col("has_file"), "pending: no file")
        .when(F.col("route").isNull(), "pending: no route")
        .when(F.col("hit"), "cached")
        .otherwise("extract")
    )
    return out.withColumn("status", status).drop("hit")
