"""The common information model and its synonyms.

Both are fixed and small (90 and 119 rows), so they enter plans as literal arrays: matching a field
name against them is a projection, not a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: common information models ----------------------------------------------------

CIM_MODELS = {
    "authentication": [
        "user", "action", "status", "src_ip", "dest_ip", "app", "reason", "signature",
        "signature_id", "vendor_product"],
    "change": [
        "object", "command", "status", "user", "app", "reason", "object_category", "object_path",
        "result"],
    "network_traffic": [
        "src_ip", "dest_ip", "src_port", "dest_port", "protocol", "action", "bytes_in",
        "bytes_out", "packets_in", "packets_out"],
    "web": [
        "src_ip", "dest_ip", "url", "uri_path", "http_method", "status", "bytes", "response_time",
        "user_agent", "referer"],
    "malware": [
        "file_name", "file_hash", "file_path", "signature", "vendor_product", "action", "user",
        "dest_ip", "src_ip"],
    "vulnerability": [
        "signature", "cve", "severity", "category", "dest_ip", "dest_port", "vendor_product",
        "description"],
    "endpoint": [
        "user", "process", "process_path", "parent_process", "file_name", "file_path", "action",
        "dest_ip", "src_ip"],
    "email": [
        "src_user", "recipient", "subject", "message_id", "action", "vendor_product", "file_name",
        "file_hash"],
    "database": [
        "user", "app", "action", "object", "object_category", "src_ip", "dest_ip", "query",
        "vendor_product"],
    "application_state": [
        "app", "status", "action", "duration", "response_time", "error_code", "vendor_product",
        "dest_ip"],
}

CIM_MODELS_SERVER = {
    "authentication": ["user", "src_ip", "dest_ip", "action", "app", "session_id"],
    "network_traffic": [
        "src_ip", "dest_ip", "src_port", "dest_port", "protocol", "bytes_in", "bytes_out"],
    "web": ["clientip", "uri_path", "status", "method", "user_agent", "referer"],
}

# --- Fixed values: synonyms of a model field, in order of preference ----------------------------

CIM_SYNONYMS = {
    "src_ip": ["src_ip", "source_ip", "clientip", "client_ip", "remote_addr", "remote_ip",
               "origin_ip"],
    "dest_ip": ["dest_ip", "destination_ip", "server_ip", "target_ip", "host_ip", "dst_ip"],
    "user": ["user", "username", "userid", "user_id", "login", "account", "principal", "auth"],
    "_time": ["timestamp", "time", "_time", "datetime", "date", "event_time"],
    "status": ["status", "response_code", "http_status", "result_code", "exit_code"],
    "action": ["action", "method", "http_method", "verb", "operation", "command"],
    "url": ["url", "uri", "request_uri", "path"],
    "uri_path": ["uri_path", "path", "request_path", "url_path"],
    "http_method": ["method", "http_method", "request_method", "verb"],
    "user_agent": ["user_agent", "useragent", "ua", "browser"],
    "referer": ["referer", "referrer", "ref"],
    "src_port": ["src_port", "source_port", "client_port", "sport"],
    "dest_port": ["dest_port", "destination_port", "server_port", "dport", "port"],
    "protocol": ["protocol", "proto", "transport"],
    "bytes": ["bytes", "size", "length", "content_length"],
    "bytes_in": ["bytes_in", "received_bytes", "rx_bytes"],
    "bytes_out": ["bytes_out", "sent_bytes", "tx_bytes"],
    "reason": ["reason", "failure_reason", "error_reason", "message"],
    "signature": ["signature", "rule", "alert", "event_type"],
    "file_name": ["file_name", "filename", "file", "name"],
    "file_path": ["file_path", "filepath", "path", "full_path"],
    "file_hash": ["file_hash", "hash", "md5", "sha1", "sha256"],
    "process": ["process", "process_name", "proc", "command"],
    "process_path": ["process_path", "proc_path", "executable", "exe"],
    "parent_process": ["parent_process", "parent_proc", "ppid"],
    "app": ["app", "application", "service", "program"],
    "vendor_product": ["vendor_product", "product", "vendor", "tool"],
}


def model_rows(variant: str = "ui") -> list[tuple[str, str, int]]:
    """``(model, cim_field, pos)`` of one variant."""
    models = CIM_MODELS if variant == "ui" else CIM_MODELS_SERVER
    return [(m, f, i) for m, fields in models.items() for i, f in enumerate(fields)]


def synonym_rows(models: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """``(cim_field, pattern)``, lower case, optionally only for fields of the given models."""
    wanted = {f for fields in models.values() for f in fields} if models else None
    return [
        (f, p.lower())
        for f, patterns in CIM_SYNONYMS.items()
        if wanted is None or f in wanted
        for p in patterns
    ]


def cim_fields(spark: SparkSession) -> DataFrame:
    """Both dictionaries as a dimension table ``(variant, model, cim_field, pos)``."""
    rows = [("ui", *r) for r in model_rows("ui")] + [("server", *r) for r in model_rows("server")]
    return spark.createDataFrame(rows, "variant string, model string, cim_field string, pos int")


def values_sql(rows: list[tuple], columns: str) -> str:
    """The rows as a SQL ``VALUES`` relation, for statements that need a dimension inline."""
    def lit(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({columns})"
