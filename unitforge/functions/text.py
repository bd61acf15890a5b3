"""Text and regex features as Column expressions (identifiers F1-F28, W1, W2, P2-P4, P10, P11 of the survey).

Null input counts as the empty string or the empty array, unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns, word lists and names whose exact form decides the results ---
URL = r"(?i)https?://[^\s\"'<>]+"
DOMAIN = r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
INTENT_ACTION = r"android\.intent\.[A-Z0-9_\.]+"
CONTENT_URI = r"(?i)content://[^\s\"'<>]+"
FILE_PATH = r"(?i)(?:/data/data|/sdcard|/storage|/mnt/|/system/)[^\s\"'<>]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
HEADER = r"(?i)\A(host|user-agent|cookie|authorization|referer|x-[a-z0-9-]+|udid|imei|imsi|mac|token)\z"
HEX = r"\A[0-9a-fA-F]{16,}\z"
BASE64 = r"\A[A-Za-z0-9+/=]{24,}\z"
BASE64_LONG = r"\A[A-Za-z0-9+/=]{40,}\z"
PACKAGE_LIKE = r"\A[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*){2,}\z"
CONST_STRING = r'^\s*const-string(?:/jumbo)?\s+v\d+,\s+"(.*)"\s*$'
HEX_LITERAL = r"\b0x[0-9a-fA-F]{6,}\b"

FEATURES = (
    "has_sensitive_api", "has_url", "has_ip", "has_domain", "has_content_uri", "has_file_path",
    "has_intent_action", "has_base64_like", "has_hex_like", "api_network", "api_location",
    "api_device_id", "api_sms", "api_crypto", "api_dynload", "api_reflection", "role_activity",
    "role_service", "role_receiver", "role_provider", "cb_lifecycle", "cb_onreceive",
    "cb_accessibility", "has_permission_string",
)
NETWORK = ("Ljava/net/", "Lorg/apache/http", "HttpURLConnection", "Lokhttp")
DEVICE_ID = ("getDeviceId", "getSubscriberId", "getLine1Number", "WifiInfo")
CRYPTO = ("Ljavax/crypto/", "MessageDigest", "Cipher", "Mac")
REFLECTION = ("Ljava/lang/reflect/", "Class;->forName", "Method;->invoke")
LIFECYCLE = ("oncreate", "onstart", "onresume", "onpause", "onstop", "ondestroy")
SOURCES = ("getSubscriberId", "getDeviceId", "getLine1Number", "WifiInfo", "LocationManager")
SINKS = ("HttpURLConnection", "Lorg/apache/http", "Socket", "execute(", "openConnection")
TRANSFORMS = ("MessageDigest", "Cipher", "Mac", "Base64")
HINTS = {
    "HINT:REFLECTION": ("Ljava/lang/reflect;", "Ljava/lang/Class;->forName", "Ljava/lang/reflect/Method;->invoke", "Ljava/lang/reflect/Constructor;->newInstance", "Ljava/lang/reflect/Field;->get", "Ljava/lang/reflect/Field;->set"),
    "HINT:DYNLOAD": ("Ldalvik/system/DexClassLoader;", "PathClassLoader", "loadClass"),
    "HINT:CRYPTO": ("Ljavax/crypto/", "MessageDigest", "Cipher", "Mac"),
    "HINT:NETWORK": ("Ljava/net/", "Lokhttp", "Lorg/apache/http", "HttpURLConnection", "Socket"),
    "HINT:SMS": ("Landroid/telephony/SmsManager;", "sendTextMessage"),
    "HINT:LOCATION": ("Landroid/location/", "getLastKnownLocation"),
    "HINT:DEVICE_ID": ("getDeviceId", "ANDROID_ID", "getSubscriberId"),
    "HINT:ACCESSIBILITY": ("Landroid/accessibilityservice/",),
    "HINT:OVERLAY": ("SYSTEM_ALERT_WINDOW", "TYPE_APPLICATION_OVERLAY"),
}
STREAM_EXTRA = "android.intent.extra.STREAM"
PARCELABLE = ("Landroid/content/Intent;->getParcelableExtra", "Landroid/content/Intent;->getParcelableArrayListExtra")
PRIMITIVES = {"boolean": "Z", "byte": "B", "char": "C", "short": "S", "int": "I", "long": "J", "float": "F", "double": "D", "void": "V"}
LEXICAL_STOP = ("", ";", ":", ",", ".", "true", "false", "null", "none")
# --- end of fixed values ---

BLANKS = r"\A\s+|\s+\z"


def strip(c: Column) -> Column:
    """Without white space at both ends; trim() alone takes blanks only."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS, "")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """Does the (case-sensitive) text hold any of the words?"""
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(c, F.lit("")).contains(w)
    return out


def any_match(items: Column, test) -> Column:
    return F.exists(F.coalesce(items, F.array().cast("array<string>")), lambda x: test(x))


def stable_topk(items: Column, limit: int) -> Column:
    """First `limit` distinct stripped non-empty items in their order; one at least, whatever the limit."""
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda x: x != "")
    return F.slice(F.array_distinct(kept), 1, max(limit, 1))


def preview(items: Column, k: int) -> Column:
    """Of the first 2k items, the first k distinct ones."""
    return stable_topk(F.slice(items, 1, 2 * k), k)


def sha_from_path(path: Column) -> Column:
    """file stem in upper case."""
    return F.upper(F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1))


def package_prefix(package: Column) -> Column:
    """package name as a class path."""
    return F.regexp_replace(F.translate(strip(package), ".", "/"), r"\A/+|/+\z", "")


def has_prefix(class_name: Column, prefix: Column) -> Column:
    """Plain prefix, without regard to path borders."""
    return class_name.startswith(prefix)


def instructions(lines: Column, unique: bool = False) -> Column:
    """Stripped lines without blanks and directives; comments and labels stay."""
    kept = F.filter(F.transform(lines, strip), lambda x: (x != "") & ~x.startswith("."))
    return F.array_distinct(kept) if unique else kept


def callee(line: Column) -> Column:
    """The last token of an instruction, without commas."""
    return F.regexp_replace(F.element_at(F.split(strip(line), r"\s+"), -1), r"\A,+|,+\z", "")


def invokes(lines: Column) -> Column:
    """Callees of invoke instructions that name a class and a method; array receivers are left out."""
    calls = F.filter(lines, lambda x: x.startswith("invoke-"))
    return F.filter(F.transform(calls, callee), lambda x: x.startswith("L") & x.contains("->"))


def string_literals(lines: Column) -> Column:
    """text between the first and the last quote of const-string instructions."""
    consts = F.filter(lines, lambda x: x.startswith("const-string") & x.rlike(r'".*"'))
    return F.transform(consts, lambda x: F.regexp_extract(x, r'"(.*)"', 1))


def const_strings(lines: Column, limit: int) -> Column:
    """literals of const-string lines with a v-register only, the first `limit`."""
    return F.slice(F.transform(F.filter(lines, lambda x: x.rlike(CONST_STRING)), lambda x: F.regexp_extract(x, CONST_STRING, 1)), 1, max(limit, 1))


def normalize_literal(c: Column) -> Column:
    """class of a string literal, or the literal itself, shortened beyond 64 characters."""
    s = strip(c)
    n = F.length(s)
    return (
        F.when(s.rlike(r"(?i)\bhttps?://"), "<URL>").when(s.rlike(r"\b\d{1,3}(\.\d{1,3}){3}\b"), "<IP>")
        .when((n >= 40) & s.rlike(r"\A[A-Za-z0-9+/=]+\z"), F.concat(F.lit("<BASE64("), n, F.lit(")>")))
        .when((n >= 32) & s.rlike(r"\A[0-9a-fA-F]+\z"), F.concat(F.lit("<HEX("), n, F.lit(")>")))
        .when(n <= 64, s).otherwise(F.concat(F.substring(s, 1, 32), F.lit("...<LEN="), n, F.lit(">")))
    )


def is_base64(c: Column, long: bool = False) -> Column:
    """F7, and with long F8: base64 characters, 24 (40) at least, and one of + / = among them."""
    s = strip(c)
    return s.rlike(BASE64_LONG if long else BASE64) & s.rlike("[+/=]")


def is_hex(c: Column) -> Column:
    """F9."""
    return strip(c).rlike(HEX)


def is_header(c: Column) -> Column:
    """F17."""
    return strip(c).rlike(HEADER)


def is_package_like(c: Column) -> Column:
    """F18."""
    return strip(c).rlike(PACKAGE_LIKE)


def extract(c: Column, pattern: str) -> Column:
    """All matches, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def extract_where(c: Column, pattern: str, *marks: str) -> Column:
    """extract(), run only on texts that hold one of the marks, without which the pattern can't match."""
    return F.when(contains_any(c, marks), extract(c, pattern)).otherwise(F.array().cast("array<string>"))


def domains(c: Column) -> Column:
    """domain names, without those of the android namespace; a domain is never a whole URL, as it has no colon."""
    return F.filter(extract_where(c, DOMAIN, "."), lambda d: ~d.startswith("android."))


def audit_literals(strings: Column, lines: Column, limit: int = 16) -> Column:
    """struct of the twelve literal lists of a method; patterns run over its strings and its first 256 instructions."""
    text = F.array_join(F.concat(strings, F.slice(lines, 1, 256)), "\n")
    picked = lambda test: F.filter(strings, lambda x: test(x))
    lists = {
        "raw_strings_topk": strings, "urls_topk": extract(text, URL), "domains_topk": domains(text), "ips_topk": extract(text, IPV4), "http_headers_topk": picked(is_header),
        "intent_actions_topk": extract(text, INTENT_ACTION), "content_uris_topk": extract(text, CONTENT_URI), "file_paths_topk": extract(text, FILE_PATH), "emails_topk": extract(text, EMAIL),
        "base64_literals_topk": picked(is_base64), "hex_literals_topk": picked(is_hex), "package_like_names_topk": picked(is_package_like),
    }
    return F.struct(*[stable_topk(c, limit).alias(name) for name, c in lists.items()])


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c worked out once, however often f reads it."""
    return F.get(F.transform(F.array(c), f), 0)


def smali_type(c: Column) -> Column:
    """a Java type name as a descriptor; arrays, varargs and generics understood, empty stays empty."""
    plain = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "<[^<>]*>", ""), "<[^<>]*>", ""), r"<.*>", ""), r"\.\.\.\z", "[]")
    codes = F.create_map(*[F.lit(x) for pair in PRIMITIVES.items() for x in pair])
    named = lambda b: F.coalesce(F.try_element_at(codes, b), F.concat(F.lit("L"), F.translate(b, ".", "/"), F.lit(";")))

    def typed(t: Column) -> Column:
        base = F.replace(t, F.lit("[]"), F.lit(""))
        dims = ((F.length(t) - F.length(base)) / 2).cast("int")
        return F.concat(F.repeat(F.lit("["), dims), _bound(strip(base), named))

    return _bound(strip(c), lambda s: F.when(s == "", "").otherwise(_bound(plain(s), typed)))


def smali_signature(line: Column) -> Column:
    """`<class: type name(types)>` as a method signature; null where the line has another form."""
    pattern = r"\A<([^:]+):\s*([^ ]+)\s+([^(]+)\(([^)]*)\)>"
    s = strip(line)
    part = lambda i: strip(F.regexp_extract(s, pattern, i))
    args = F.filter(F.transform(F.split(part(4), ","), strip), lambda a: a != "")
    out = F.concat(F.lit("L"), F.translate(part(1), ".", "/"), F.lit(";->"), part(3), F.lit("("), F.array_join(F.transform(args, smali_type), ""), F.lit(")"), smali_type(part(2)))
    return F.when(s.rlike(pattern), out)


def symbolic_features(name: Column, calls: Column, strings: Column, sensitive: Column, roles: Column) -> Column:
    """the 24 features of a method as zeros and ones, in the order of FEATURES. sensitive: boolean; roles: array."""
    inv, text, mn = F.array_join(calls, "\n"), F.array_join(strings, "\n"), F.lower(F.coalesce(name, F.lit("")))
    starts = lambda *words: F.coalesce(mn.rlike(r"\A(?:" + "|".join(words) + ")"), F.lit(False))
    role = lambda r: F.coalesce(F.array_contains(roles, r), F.lit(False))
    tests = {
        "has_sensitive_api": F.coalesce(sensitive, F.lit(False)), "has_url": text.rlike(URL), "has_ip": text.rlike(IPV4), "has_domain": text.rlike(DOMAIN),
        "has_content_uri": text.rlike(CONTENT_URI), "has_file_path": text.rlike(FILE_PATH), "has_intent_action": text.rlike(INTENT_ACTION),
        "has_base64_like": any_match(strings, is_base64), "has_hex_like": any_match(strings, is_hex), "api_network": contains_any(inv, (*NETWORK, "Socket")),
        "api_location": contains_any(inv, ("Landroid/location/",)), "api_device_id": contains_any(inv, DEVICE_ID), "api_sms": contains_any(inv, ("SmsManager",)),
        "api_crypto": contains_any(inv, CRYPTO), "api_dynload": contains_any(inv, ("DexClassLoader", "PathClassLoader", "loadClass")), "api_reflection": contains_any(inv, REFLECTION),
        "role_activity": role("activity"), "role_service": role("service"), "role_receiver": role("receiver"), "role_provider": role("provider"),
        "cb_lifecycle": starts(*LIFECYCLE), "cb_onreceive": starts("onreceive"), "cb_accessibility": starts("onaccessibility"), "has_permission_string": contains_any(text, ("android.permission.",)),
    }
    return F.array(*[tests[f].cast("float") for f in FEATURES])


def family_tags(name: Column, calls: Column) -> Column:
    """sorted tags of what a method calls and is called for."""
    inv, mn = F.array_join(calls, "\n"), F.lower(F.coalesce(name, F.lit("")))
    tests = {
        "accessibility_callback": mn.startswith("onaccessibility"), "crypto": contains_any(inv, CRYPTO), "device_id": contains_any(inv, DEVICE_ID),
        "dynload": contains_any(inv, ("Ldalvik/system/DexClassLoader;", "PathClassLoader", "loadClass")), "lifecycle": mn.rlike(r"\A(?:oncreate|onstart|onresume)"),
        "location": contains_any(inv, ("Landroid/location/", "LocationManager")), "network": contains_any(inv, NETWORK), "receiver_callback": mn.startswith("onreceive"),
        "reflection": contains_any(inv, REFLECTION),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(tag)) for tag, test in tests.items()]))


def callback_flags(tags: Column) -> Column:
    """F24."""
    return F.filter(tags, lambda t: t.endswith("callback") | t.endswith("lifecycle"))


def evidence_spans(lines: Column, perms_of: Column, limit: int = 16) -> Column:
    """The first `limit` calls and string literals of a method with their role; perms_of: map of callee to permissions."""

    def span(line: Column, i: Column) -> Column:
        s = strip(line)
        called, value = callee(s), F.regexp_extract(s, r'"(.*)"', 1)
        is_call, is_text = s.startswith("invoke-"), s.startswith("const-string") & s.rlike(r'".*"')
        role = F.when(contains_any(called, SOURCES), "source").when(contains_any(called, SINKS), "sink").when(contains_any(called, TRANSFORMS), "transform").otherwise("other")
        indicator = F.when(value.rlike(URL), "network_indicator").when(value.rlike(INTENT_ACTION), "intent_indicator").when(value.rlike(FILE_PATH), "file_indicator").otherwise("other")
        row = F.struct(
            F.when(is_call, "API_CALL").otherwise("STRING_LITERAL").alias("kind"), (i + 1).alias("line_no"), s.alias("text"), F.when(is_call, called).alias("callee"),
            F.when(~is_call, F.substring(value, 1, 240)).alias("value"), F.when(is_call, role).otherwise(indicator).alias("role_hint"), F.when(is_call, F.try_element_at(perms_of, called)).alias("perms"),
        )
        return F.when(is_call | is_text, row)

    return F.slice(F.filter(F.transform(lines, span), lambda x: x.isNotNull()), 1, limit)


def evidence_summary(spans: Column) -> Column:
    """A4: does any span have the role?"""
    has = lambda r: F.exists(spans, lambda x: x["role_hint"] == r)
    return F.struct(has("source").alias("has_source_like"), has("sink").alias("has_sink_like"), has("transform").alias("has_transform_like"))


def hints(text: Column) -> Column:
    """sorted hints that a method's text gives."""
    s = F.coalesce(text, F.lit(""))
    tests = {tag: contains_any(s, words) for tag, words in HINTS.items()}
    tests |= {"LIT:URL_PRESENT": s.rlike("(?i)https?://|ftp://"), "LIT:IP_PRESENT": s.rlike(IPV4), "LIT:HEX_LIKE": s.rlike(HEX_LITERAL), "HINT:INTENT_EXTRA_STREAM": s.contains(STREAM_EXTRA) & contains_any(s, PARCELABLE)}
    return F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(tag)) for tag, test in tests.items()])))


def is_lexical_anchor(t: Column) -> Column:
    """P10: does a literal say something about behaviour: intents, permissions, paths, packages, verbs, types, constants?"""
    low = F.lower(t)
    return (
        low.startswith("android.intent.") | low.startswith("android.permission.") | t.rlike(r"(?i)\A/|/sdcard/|/Android/") | t.rlike(r"(?i)\.apk\z") | t.isin("GET", "POST", "PUT", "DELETE")
        | (t.contains("/") & (low.contains("vnd.android") | low.contains("application/"))) | (t.rlike(r"\A[A-Z0-9_]{3,}\z") & ~t.isin("TRUE", "FALSE"))
    )


def clean_lexical(items: Column, limit: int) -> Column:
    """Distinct anchors among the stripped items of three characters or more, in order."""
    kept = F.filter(F.transform(items, strip), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*LEXICAL_STOP) & is_lexical_anchor(t))
    return F.slice(F.array_distinct(kept), 1, max(limit, 1))


def chunked(tokens: Column, width: int) -> Column:
    """Consecutive windows of `width` tokens; one empty window for no tokens."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(tokens) - 1, F.lit(0)) / width).cast("int"))
    return F.transform(starts, lambda i: F.slice(tokens, i * width + 1, F.lit(width)))


def truncated(tokens: Column, width: int) -> Column:
    """V13 in truncate mode: the first window alone; token_len_raw is the length after the cut."""
    first = F.slice(tokens, 1, width)
    return F.struct(F.array(first).alias("chunks"), F.size(first).alias("token_len_raw"))


def hashed_vector(tokens: Column, width: int = 64) -> Column:
    """Embedding by feature hashing: each token adds one, up or down, at a place that its digest tells; brought to unit length."""
    code = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"))
    zero = F.array_repeat(F.lit(0.0), width)
    sign = lambda c: F.when(F.floor(c / width) % 2 == 0, 1.0).otherwise(-1.0)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda v: F.transform(v, lambda x: x / F.when(length(v) == 0, F.lit(1.0)).otherwise(length(v)))
    return F.aggregate(code, zero, lambda v, c: F.transform(v, lambda x, i: F.when(i == c % width, x + sign(c)).otherwise(x)), unit)


def external_vector(sig: Column, perms: Column, mode: str = "zero", width: int = 64) -> Column:
    """Vector of an external method: zeros, or that of its signature text's tokens; other modes are refused."""
    if mode not in ("zero", "signature"):
        raise ValueError(f"unknown mode for external methods: {mode}")
    return F.array_repeat(F.lit(0.0), width) if mode == "zero" else hashed_vector(F.split(signature_text(sig, perms), r"\s+"), width)


def method_text(name: Column, lines: Column, invoke_only: bool = False) -> Column:
    """What an embedder reads of a method: its name and its instructions, or what these call."""
    body = F.transform(F.filter(lines, lambda x: x.startswith("invoke-")), callee) if invoke_only else lines
    return F.array_join(F.concat(F.array(F.concat(F.lit("MethodName: "), F.coalesce(name, F.lit("")))), body), "\n")


def signature_text(sig: Column, perms: Column) -> Column:
    """What an embedder reads of an external method: its signature and up to six permissions."""
    some = F.slice(F.coalesce(perms, F.array().cast("array<string>")), 1, 6)
    return F.concat(F.lit("MethodName: "), sig, F.when(F.size(some) > 0, F.concat(F.lit(" Perms: "), F.array_join(some, " "))).otherwise(""))
