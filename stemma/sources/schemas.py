"""Declared schemas of the tables that the engine works on."""

INFILE = "STRUCT<pos:INT, blob:STRING, path:STRING, has_cve:ARRAY<STRING>, fixed_cve:ARRAY<STRING>, prov_pkg:STRING>"
DYNLIB = "STRUCT<pos:INT, blob:STRING, path:STRING>"
RECORD = (
    "seq BIGINT, pid STRING, exec_mode STRING, out_blob STRING, out_path STRING, build_cmd STRING, build_tool STRING, "
    f"pkg_info STRING, prune STRING, ignore BOOLEAN, infiles ARRAY<{INFILE}>, dynlibs ARRAY<{DYNLIB}>"
)
CVE_STATUS = "blob STRING, file_path STRING, cve STRING, status STRING"
CVE_ENTRY = (
    "STRUCT<file_path:STRING, NoCVElist:ARRAY<STRING>, CVElist:ARRAY<STRING>, FixedCVElist:ARRAY<STRING>, "
    "cvehint_CVElist:ARRAY<STRING>, cvehint_FixedCVElist:ARRAY<STRING>>"
)
CVE_RULE = "rule_ord INT, cve STRING, src_file STRING, rule_type STRING, include ARRAY<ARRAY<STRING>>, exclude ARRAY<ARRAY<STRING>>"
CVE_COMMIT = "cve STRING, kind STRING, commit STRING, src_files ARRAY<STRING>"
GIT_CHANGE = "ord BIGINT, commit STRING, path STRING, src_blob STRING, dst_blob STRING, change STRING"
