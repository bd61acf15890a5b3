"""Schemas of the tables between the stages, as DDL strings."""

METHODS = """year string, apk_sha256 string, apk_path string, package string, method_sig string, class_name string, method_name string,
 instructions array<string>, invokes array<string>, strings array<string>, embedding array<float>, symbolic_features array<float>"""
EDGES = "year string, apk_sha256 string, caller string, callee string, kind string, callee_is_sensitive int, callee_perms array<string>"
MANIFEST = "package string, permissions array<string>, activities array<string>, services array<string>, receivers array<string>, providers array<string>"
NODES = "year string, apk_sha256 string, node_id int, sig string, is_external int, is_sensitive int, perms array<string>, x_base array<float>, x_symbolic array<float>"
GRAPH_EDGES = "year string, apk_sha256 string, src int, dst int, is_fwd boolean"
LABELS = "apk_id string, sha string, family string, behaviors array<string>"
UNITS = """year string, apk_sha256 string, unit_id string, sapi array<string>, perms map<string, array<string>>, hints array<string>, lexical array<string>,
 unit_emb array<double>, edges array<array<int>>"""
STATE = """apk_id string, verdict string, confidence double, family string, family_candidates array<string>, behaviors array<string>, mechanisms array<string>,
 processed_bu_ids array<string>, changed_fields array<string>, note string"""

APK_KEY = ["year", "apk_sha256"]
