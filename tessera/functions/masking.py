"""Secret masking: ordered rules, each over the result of the one before. All are built-in expressions.

compat leaves what the rule set leaves (key = "value" with a space after the sign); strict, the default, masks it too.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    name: str
    pattern: str
    replacement: str
    #: replaced again within each match, instead of by replacement
    inner: str | None = None


# Key names, literals, and the patterns and labels of the rules, in order, specific before general.
KEYS = (
    r"(?:password|passwd|pwd|secret|token|bearer_token|api[_-]?key|x[-_]?api[-_]?key|access[_-]?key|private[_-]?key|"
    r"client[_-]?secret|refresh[_-]?token|jwt[_-]?secret|auth[_-]?token|x[-_]?vault[-_]?token|"
    r"keycloak[_-]?admin[_-]?password|keystorePassword|truststorePassword)"
)
LITERALS = ("SAMPLE_TOKEN_123456", "SAMPLE_PASSWORD_321", "SAMPLE_PASSWORD_444")
_MASK = "[REDACTED]"
RULES = (
    Rule("pem_encrypted_key", r"(?s)-----BEGIN ENCRYPTED PRIVATE KEY-----.*?-----END ENCRYPTED PRIVATE KEY-----", "[ENCRYPTED PRIVATE KEY REDACTED]"),
    Rule("pem_private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[PRIVATE KEY REDACTED]"),
    Rule("pem_certificate", r"(?s)-----BEGIN CERTIFICATE-----.*?-----END CERTIFICATE-----", "[CERTIFICATE REDACTED]"),
    Rule("pgp_private_key", r"(?s)-----BEGIN PGP PRIVATE KEY BLOCK-----.*?-----END PGP PRIVATE KEY BLOCK-----", "[PGP PRIVATE KEY REDACTED]"),
    Rule("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", "[AWS ACCESS KEY REDACTED]"),
    Rule("gitlab_pat", r"(?i)\bglpat-[A-Za-z0-9_-]{20,64}\b", "[GITLAB PAT REDACTED]"),
    Rule("vault_token", r"\b(hvs\.[A-Za-z0-9]{20,256}|s\.[A-Za-z0-9]{20,256})\b", "[VAULT TOKEN REDACTED]"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{20,2048}\.[A-Za-z0-9_-]{20,2048}\.[A-Za-z0-9_-]{20,2048}\b", "[JWT REDACTED]"),
    Rule("bearer_header", r"(?im)Authorization:\s*Bearer\s+[A-Za-z0-9\-._~+/=]{8,512}", f"Authorization: Bearer {_MASK}"),
    Rule("basic_header", r"(?im)Authorization:\s*Basic\s+[A-Za-z0-9+/=]{8,512}", f"Authorization: Basic {_MASK}"),
    Rule("api_key_header", r"(?im)(X[-_](?:API[-_]Key|JFrog[-_]Art[-_]Api|Vault[-_]Token)):\s*[^\s]{1,256}", f"$1: {_MASK}"),
    Rule("jdbc_password", r"(?i)(jdbc:[a-z0-9:]+//[^\s]+?[?&;]password=)([^&;\s]{1,256})", f"$1{_MASK}"),
    Rule("uri_credentials", r"(?i)(\b[a-z][a-z0-9+\-.]*://)([^:@\s]{1,256}):([^@/\s]{1,256})@", f"$1$2:{_MASK}@"),
    Rule("url_parameter", r"(?i)([?&](?:password|pwd|pass|tlsCertificateKeyFilePassword|sslpassword|client_key_password)=)([^&#;\s]{1,256})", f"$1{_MASK}"),
    Rule("dsn_password", r"(?i)([;,\s])((?:password|pwd|pass)\s*=\s*)([^;,\s]{1,256})(?=[;,\s]|$)", f"$1$2{_MASK}"),
    Rule("key_value", rf"(?i)\b({KEYS})(\s*[:=]\s*)([^\s'\"\\]{{4,256}})", f"$1$2{_MASK}"),
    Rule("key_quoted", rf"(?i)\b({KEYS})\s*:\s*(['\"])[^'\"\\]{{4,256}}\2", f"$1: $2{_MASK}$2"),
    Rule("key_json", rf'(?i)"({KEYS})"\s*:\s*"[^"\\]{{4,256}}"', f'"$1": "{_MASK}"'),
    Rule("config_key", r"(?im)^\s*(spring\.datasource\.(?:password|hikari\.password)|flyway\.password|liquibase\.password|spring\.mail\.password|keycloak\.(?:credentials\.secret|password)|(?:vertica|clickhouse)\.password)(\s*[:=]\s*).+$", f"$1$2{_MASK}"),
    Rule("environment", r"(?i)\b(VAULT[_-]?TOKEN|CI[_-]JOB[_-]TOKEN|JFROG_(?:ACCESS_TOKEN|API_KEY)|ARTIFACTORY_API_KEY|KEYCLOAK_ADMIN_PASSWORD|KC_DB_PASSWORD|KC_HTTPS_PASSWORD|(?:SMTP|MAIL)[_-]?PASSWORD)(\s*[:=]\s*)[^\s]{1,256}", f"$1$2{_MASK}"),
    Rule("vault_role", r"(?i)\b(role_id|secret_id)(\s*[:=]\s*)[0-9a-f\-]{16,256}", f"$1$2{_MASK}"),
    Rule("registration_token", r"(?i)\b(registration[_-]?token)(\s*[:=]\s*)[A-Za-z0-9\-_]{8,256}\b", f"$1$2{_MASK}"),
    Rule("aws_secret_key", r"(?i)\b(aws[_-]?secret[_-]?access[_-]?key)(\s*[:=]\s*)[A-Za-z0-9/+=]{30,256}", f"$1$2{_MASK}"),
    Rule("curl_user", r"(?i)(-u\s+)([^:\s]{1,64}):([^\s]{1,256})", f"$1$2:{_MASK}"),
    Rule("kubeconfig", r"(?im)^(\s*(?:token|client-key-data|client-certificate-data|certificate-authority-data)\s*):\s*[A-Za-z0-9+/=\n]{40,8192}\s*$", f"$1: {_MASK}"),
    Rule("k8s_secret", r"(?is)\bkind:\s*Secret\b.*?\b(?:data|stringData):\s*\{[^}]*\}", f": {_MASK}", r":\s*[^,}\s]+"),
    Rule("json_auth", r'(?i)("(?:auth|secret)"\s*):\s*"[A-Za-z0-9._\-]{16,256}"', f'$1: "{_MASK}"'),
    Rule("xml_password", r"(?is)<(password|passphrase)>[^<]{1,1024}</\1>", f"<$1>{_MASK}</$1>"),
    Rule("attribute_double", rf'(?i)(\b{KEYS}\s*)="[^"{{}}]{{1,256}}"', f'$1="{_MASK}"'),
    Rule("attribute_single", rf"(?i)(\b{KEYS}\s*)='[^'{{}}]{{1,256}}'", f"$1='{_MASK}'"),
    Rule("properties", r"(?im)^(artifactory_password|systemProp\.(?:http|https)\.proxyPassword)(\s*=\s*).+$", f"$1$2{_MASK}"),
    Rule("literal", "|".join(LITERALS), _MASK),
)
# End of the fixed values.

STRICT = (Rule("attribute_spaced", rf"""(?i)\b({KEYS}\s*=\s+)(["'])[^"'{{}}]{{1,256}}\2""", f"$1$2{_MASK}$2"),)
#: For engines without lookaround: the strict rule for double quotes, and what the other rules need in a text.
STRICT_SQL = rf'(?i)\b({KEYS}\s*=\s+)(")[^"{{}}]{{1,256}}"'
OTHERS_SQL = r"-----BEGIN|AKIA|(?i)glpat-|hvs\.|eyJ|authorization:|://[^\s]*@|role_id|-u\s|SAMPLE_|(?:pass|pwd|secret|token|key)\w*\s*[:=]\s*[^\s\"]"
#: What a text needs for any rule to match: rows without it skip the chain.
_GATE = r"(?i)-----BEGIN|AKIA|glpat-|hvs\.|\bs\.[a-z0-9]{20}|eyJ|authorization:|x[-_](?:api|jfrog|vault)|pass|pwd|secret|token|key|://[^\s]*@|role_id|-u\s|-data\s*:|\"auth\"|SAMPLE_"
#: Only \n ends a line, and character classes know Unicode.
_FLAGS = "(?dU)"


def rules(mode: str = "strict") -> tuple[Rule, ...]:
    if mode not in ("strict", "compat"):
        raise ValueError(f"mode is strict or compat, not {mode}")
    return RULES + STRICT * (mode == "strict")


def apply_rule(text: Column, rule: Rule) -> Column:
    pattern = _FLAGS + rule.pattern
    if rule.inner is None:
        return F.regexp_replace(text, pattern, rule.replacement)
    # the parts between matches, each followed by its match with the inner replacement
    inside = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.regexp_replace(m, _FLAGS + rule.inner, rule.replacement))
    joined = F.zip_with(F.split(text, pattern, -1), inside, lambda part, match: F.concat(part, F.coalesce(match, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(joined, "")).otherwise(text)


def masked(text: Column | str, mode: str = "strict") -> Column:
    source = F.col(text) if isinstance(text, str) else text
    out = source
    for rule in rules(mode):
        out = apply_rule(out, rule)
    return F.when(source.rlike(_GATE), out).otherwise(source)


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "strict") -> DataFrame:
    """(key, rule, hits): how often each rule replaced something. Never the values."""
    gated = docs.where(F.col(text).rlike(_GATE)).select(key, F.col(text).alias("__t"))
    counts = []
    for k, rule in enumerate(rules(mode)):
        gated = gated.withColumns({f"__n{k}": F.regexp_count("__t", F.lit(_FLAGS + rule.pattern)), "__t": apply_rule(F.col("__t"), rule)})
        counts.append(F.struct(F.lit(rule.name).alias("rule"), F.col(f"__n{k}").cast("long").alias("hits")))
    return gated.select(key, F.inline(F.array(*counts))).where("hits > 0")


# Detectors of the audit and the entropy limits of quoted tokens.
DETECTORS = {
    "AWS Access Key": r"(?:A3T[A-Z0-9]|ABIA|ACCA|AKIA|ASIA)[0-9A-Z]{16}",
    "Private Key": r"BEGIN (?:DSA |EC |OPENSSH |PGP |RSA |SSH2 ENCRYPTED )?PRIVATE KEY",
    "Basic Auth Credentials": r"://[^:/?#\[\]@!$&'()*+,;=\s]+:([^:/?#\[\]@!$&'()*+,;=\s]+)@",
    "JSON Web Token": r"eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\.?[A-Za-z0-9_.+/=-]*",
    "GitHub Token": r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36}",
    "Slack Token": r"(?i)xox(?:a|b|p|o|s|r)-(?:\d+-)+[a-z0-9]+",
    "Stripe Access Key": r"(?:r|s)k_live_[0-9a-zA-Z]{24}",
}
ENTROPY = {"Hex High Entropy String": (r"[\"']([0-9a-fA-F]{8,})[\"']", 3.0), "Base64 High Entropy String": (r"[\"']([A-Za-z0-9+/=_-]{20,})[\"']", 4.5)}
# End of the fixed values.


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(characters)
    share = lambda c: (n - F.size(F.array_remove(characters, c))) / n
    return F.aggregate(F.array_distinct(characters), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def audit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, type): what may still be a secret, in masked text. It changes nothing and reports no value."""
    by_line = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "__l")).withColumn("line", F.col("line") + 1)
    hits = [F.when(F.col("__l").rlike(p), F.lit(t)) for t, p in DETECTORS.items()]
    for t, (pattern, limit) in ENTROPY.items():
        tokens = F.regexp_extract_all("__l", F.lit(pattern), F.lit(1))
        hits.append(F.when(F.size(F.filter(tokens, _over(limit))) > 0, F.lit(t)))
    return by_line.select(key, "line", F.explode(F.array_compact(F.array(*hits))).alias("type"))


def _over(limit: float):
    return lambda token: entropy(token) > limit
