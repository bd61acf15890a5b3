from pyspark.sql import functions as F

from unitforge.functions import sets as X
from unitforge.functions import state as S
from unitforge.functions import text as T
from unitforge.functions import vectors as V
from unitforge.sources import readers as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lits(*items):
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")


def test_literals(spark):
    cases = {
        "see https://a.b/c": "<URL>", "ip 10.0.0.1 x": "<IP>", "A" * 40: "<BASE64(40)>", "abcdef0123456789abcdef0123456789": "<HEX(32)>",
        " plain ": "plain", "x y" * 30: ("x y" * 30)[:32] + "...<LEN=90>", "": "",
    }
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.normalize_literal(F.col("s")).alias("n")).collect()
    assert {r["s"]: r["n"] for r in got} == cases
    assert one(spark, T.is_base64(F.lit("QUJDREVGR0hJSktMTU5PUA=="))) and not one(spark, T.is_base64(F.lit("A" * 30)))
    assert one(spark, T.is_hex(F.lit("0123456789abcdef"))) and not one(spark, T.is_hex(F.lit("0123456789abcdef\n x")))
    assert one(spark, T.is_package_like(F.lit("com.a.b"))) and not one(spark, T.is_package_like(F.lit("com.a")))
    assert one(spark, T.is_header(F.lit("X-Foo-1"))) and not one(spark, T.is_header(F.lit("X_Foo")))


def test_topk(spark):
    assert one(spark, T.stable_topk(lits(" b", "a", "b ", "", None, "c"), 2)) == ["b", "a"]
    assert one(spark, T.stable_topk(lits("b", "a"), 0)) == ["b"]
    assert one(spark, T.stable_topk(F.lit(None).cast("array<string>"), 3)) == []
    assert one(spark, T.preview(lits("a", "a", "b", "c"), 1)) == ["a"]
    assert one(spark, T.chunked(lits("a", "b", "c"), 2)) == [["a", "b"], ["c"]]
    assert one(spark, T.chunked(lits(), 2)) == [[]]


def test_extracts(spark):
    text = F.lit("mail a.b@c.org at www.x.com or android.app.foo from 10.1.2.3 content://q/r /sdcard/z android.intent.action.VIEW")
    assert "www.x.com" in one(spark, T.domains(text)) and "android.app.foo" not in one(spark, T.domains(text))
    lists = one(spark, T.audit_literals(lits("host", "0123456789abcdef", "com.a.b", "https://x.y/z"), F.array(text)))
    assert lists["emails_topk"] == ["a.b@c.org"] and lists["ips_topk"] == ["10.1.2.3"] and lists["http_headers_topk"] == ["host"] and lists["hex_literals_topk"] == ["0123456789abcdef"]
    assert lists["package_like_names_topk"] == ["com.a.b"] and lists["content_uris_topk"] == ["content://q/r"] and lists["file_paths_topk"] == ["/sdcard/z"] and lists["urls_topk"] == ["https://x.y/z"]


def test_method_features(spark):
    lines = lits('const-string v0, "http://evil.com/x"', "invoke-virtual {v0}, Landroid/telephony/TelephonyManager;->getDeviceId()Ljava/lang/String;", "invoke-static {}, Ljavax/crypto/Cipher;->getInstance()V", "nop")
    calls = T.invokes(lines)
    assert one(spark, calls) == ["Landroid/telephony/TelephonyManager;->getDeviceId()Ljava/lang/String;", "Ljavax/crypto/Cipher;->getInstance()V"]
    assert one(spark, T.family_tags(F.lit("onCreate"), calls)) == ["crypto", "device_id", "lifecycle"]
    v = one(spark, T.symbolic_features(F.lit("onPause"), calls, T.string_literals(lines), F.lit(True), lits("service")))
    on = {f for f, x in zip(T.FEATURES, v, strict=True) if x}
    assert on == {"has_sensitive_api", "has_url", "has_domain", "api_device_id", "api_crypto", "role_service", "cb_lifecycle"}
    spans = one(spark, T.evidence_spans(lines, F.create_map(F.lit("Ljavax/crypto/Cipher;->getInstance()V"), lits("P"))))
    assert [(s["kind"], s["line_no"], s["role_hint"], s["perms"]) for s in spans] == [("STRING_LITERAL", 1, "network_indicator", None), ("API_CALL", 2, "source", None), ("API_CALL", 3, "transform", ["P"])]
    assert one(spark, T.hints(F.lit("Cipher 0xdeadbeef ftp://x loadClass"))) == ["HINT:CRYPTO", "HINT:DYNLOAD", "LIT:HEX_LIKE", "LIT:URL_PRESENT"]
    assert one(spark, T.clean_lexical(lits("GET", "TRUE", "/data/x", "hello", "ABC", "GET", "null"), 8)) == ["GET", "/data/x", "ABC"]
    assert one(spark, T.const_strings(lits('  const-string v1, "a"', 'const-string p1, "b"'), 5)) == ["a"]


def test_signatures(spark):
    cases = {
        "<a.B: void f(int,java.lang.String[],long...)>": "La/B;->f(I[Ljava/lang/String;[J)V", "<a.B: java.util.List<java.lang.String> g()>": "La/B;->g()Ljava/util/List;", "nothing": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.smali_signature(F.col("s")).alias("x")).collect()
    assert {r["s"]: r["x"] for r in got} == cases
    text = "<early.Sig: void x()>\nPermission:P1\n<a.B: void f(int)> (v)\n\nPermission:P2\n<a.B: void f(int)>\n<a.B: void <init>(int)>\njunk"
    got = R.permission_map(spark.createDataFrame([(text,)], "value string")).collect()
    assert [(r["api_sig"], r["perms"]) for r in got] == [("La/B;->f(I)V", ["P1", "P2"])]


def test_sets_and_vectors(spark):
    assert one(spark, X.jaccard(lits("a", "b"), lits("b", "c"))) == 1 / 3
    assert one(spark, X.jaccard(lits(), lits())) == 1.0 and one(spark, X.jaccard(lits("a"), lits())) == 0.0
    psi = X.symbolic_tokens(lits(" s"), lits("p", ""), lits("HINT:X"), lits("l"), F.create_map(F.lit("source"), F.lit(2), F.lit("sink"), F.lit(0)))
    assert one(spark, psi) == ["HINT:HINT:X", "LIT:l", "PERM:p", "ROLE:source", "SAPI:s"]
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, V.l2_normalize(a)) == [0.6, 0.8] and one(spark, V.unit_cosine(a, F.array(F.lit(1.0)))) == -1.0
    assert abs(one(spark, V.multi_view_similarity({"unit_emb": a}, {"unit_emb": b})) - 0.6) < 1e-12
    assert one(spark, V.multi_view_similarity({"unit_emb": F.lit(None).cast("array<double>")}, {"unit_emb": b})) == -1.0


def test_states(spark):
    assert one(spark, S.safe_json(F.lit('so: {"a": {"b": 1}} ok'))) == '{"a": {"b": 1}}'
    assert one(spark, S.safe_json(F.lit("[1]"))) == "{}" and one(spark, S.safe_json(F.lit(None).cast("string"))) == "{}"
    assert one(spark, S.reply_text(F.lit('{"choices":[{"message":{"content":"hi"}}]}'))) == "hi"
    assert one(spark, S.reply_text(F.lit('{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}'))) == "a\nb"
    assert one(spark, S.reply_text(F.lit('{"output":[{"content":[{"text":"x"}]}]}'))) == "x" and one(spark, S.reply_text(F.lit("plain"))) == "plain"
    assert [one(spark, S.confidence(F.lit(x))) for x in ("150", "abc", "NaN", "-3", "50")] == [100.0, 0.0, 100.0, 0.0, 50.0]
    gate = lambda conf, behaviors: one(spark, S.gate(F.lit("MALICIOUS "), F.lit(conf), F.lit("fam"), behaviors, lits(), F.lit("old")))
    strong = gate("90", lits("Data Exfiltration"))
    assert (strong["verdict"], strong["family"], strong["strong_hits"], strong["note"]) == ("malicious", "fam", 2, "old")
    weak = gate("60", lits("spyware"))
    assert (weak["verdict"], weak["family"], weak["note"]) == ("unknown", "unknown", "old | verdict_gate: weaken malicious->unknown (conf=60.0, strong_hits=1, behaviors=1)")
