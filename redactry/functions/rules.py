"""The rule registry: which patterns make a span of which type, and how sure they are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from redactry.functions import validators


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    score: float
    #: What every match holds: a name in HINTS. Texts without it are not searched, which changes no result.
    hint: str = ""


#: Short scans that rule long ones out. Words are searched in any case.
HINTS = {
    "digit": r"\d",
    "8 digits": r"\d{8}",
    "group": r"[.,]\d{3}",
    "dash group": r"\d[.\-]\d{3}",
    "long fraction": r"\.\d{4}",
    "dotted": r"\d\.\d{1,3}\.\d",
    "digit run": r"\d(?:[ \-]?\d){11}",
    "year": r"/(?:19|20)\d\d/",
    "code": r"[A-Z][\-/]\d",
    "contract": r"(?:HD|HĐ|NDA)[\-/]\d",
    "at": r"@",
    "colons": r"[0-9A-F]:[0-9A-F:]|::",
    "pairs": r"[0-9A-F][:\-][0-9A-F]{2}[:\-]",
    "plus": r"\+\d|0084",
    "bracket": r"\(\d",
    "dashed": r"\d{3}[ .\-]\d{3}[ .\-]\d{4}",
    "scheme": r"://",
    "credential": r"mật khẩu|mat khau|password|\bpin\b|mã pin|ma pin|otp",
    "pem": r"-----BEGIN",
    "aws": r"AKIA",
    "sk": r"sk-",
    "jwt": r"eyJ",
    "house": r"Số\s",
    "ssn": r"\d{3}-\d\d-",
}


@dataclass(frozen=True)
class Rule:
    """A recognizer: each pattern yields candidates, context words near one raise its score, a validator may drop it.

    ``validate`` takes the matched text and gives the final score, or None to drop the match.
    """

    entity_type: str
    patterns: tuple[Pattern, ...]
    context: frozenset[str] = frozenset()
    validate: Callable[[str], float | None] | None = field(default=None, compare=False)


def rule(entity_type: str, context: str, *patterns: tuple, validate=None) -> Rule:
    return Rule(entity_type, tuple(Pattern(n, r, s, h[0] if h else "") for n, s, r, *h in patterns), frozenset(context.split()), validate)


# The patterns, scores and context words of the custom categories.
# All patterns ignore case; "." crosses lines; \b, \w and \d follow Unicode.
CUSTOM = (
    rule(
        "CONTRACT_ID", "lục luc thuận thuan mật mat bồi boi contract agreement nda clause",
        ("prefix, year, code", 0.75, r"\b(?:HD|HĐ|NDA)[-/][0-9]{4}[-/][A-Z0-9]{2,8}\b", "contract"),
        ("number, year, code", 0.6, r"\b\d{1,4}/(?:19|20)\d{2}/[A-ZĐ]{2,10}\b", "year"),
        ("generic code", 0.3, r"\b[A-Z]{2,6}[-/]\d{2,4}[-/][A-Z0-9]{2,10}\b", "code"),
    ),
    rule(
        "INTERNAL_TAX_CODE", "thuế thue mst tax code doanh nghiệp nghiep",
        ("10 digits, no mobile prefix", 0.25, r"\b0(?![35789])\d{9}\b|\b[1-9]\d{9}\b", "8 digits"),
        ("13 digits with branch", 0.4, r"\b\d{10}-\d{3}\b", "8 digits"),
    ),
    rule(
        "FINANCIAL_METRIC", "lương luong nhuận nhuan phí phi ngân ngan phạt phat salary revenue budget",
        ("amount", 0.35, r"\b[\d]{1,3}(?:[.,]\d{3})+(?:\s?(?:VND|VNĐ|đ|USD))?\b|\$\s?[\d]{1,3}(?:[.,]\d{3})*"),
    ),
    rule(
        "EMPLOYEE_ID", "nhân nhan chấm cham employee performance payroll",
        ("employee code", 0.5, r"\b(?:NV|EMP|STAFF)[-\s]?\d{3,8}\b"),
    ),
    rule(
        "INFRA_SECRET", "secret key token password credential connection string database api",
        ("cloud access key id", 0.9, r"\bAKIA[0-9A-Z]{16}\b", "aws"),
        ("sk- key", 0.75, r"\bsk-[A-Za-z0-9_-]{20,}\b", "sk"),
        ("web token", 0.8, r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "jwt"),
        ("database address", 0.85, r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s'\"]{5,}\b", "scheme"),
        ("assigned secret", 0.4, r"(?:api[_-]?key|secret|token|password|pwd)\s*[:=]\s*['\"]?[A-Za-z0-9\-_.]{6,}['\"]?"),
    ),
    rule(
        "IP_SENSITIVE_MARKER", "source code design doc patent quyền quyen hữu huu tuệ tue know-how quyết quyet",
        ("marker", 0.35, r"\b(?:confidential|proprietary|trade secret|internal use only|bí mật kinh doanh|tài liệu mật|không phổ biến)\b"),
    ),
    rule(
        "CRYPTO_PRIVATE_KEY", "certificate private ssl tls key",
        ("PEM header", 0.95, r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY(?: BLOCK)?-----", "pem"),
    ),
    rule(
        "INFRA_NETWORK_MAP", "server subnet vpc gateway router mạng mang hạ tầng tang firewall network",
        ("private IPv4", 0.55, r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})(?:/\d{1,2})?\b", "dotted"),
        ("IPv4 block", 0.5, r"\b(?:\d{1,3}\.){3}\d{1,3}/\d{1,2}\b", "dotted"),
    ),
    rule(
        "GPS_LOCATION", "toạ toa vĩ vi gps location lat long coordinates",
        ("decimal pair", 0.25, r"-?\b\d{1,3}\.\d{4,8}\b,\s*-?\b\d{1,3}\.\d{4,8}\b", "long fraction"),
    ),
    rule(
        "FINANCIAL_CREDENTIAL", "ngân ngan hàng hang tài tai khoản khoan thẻ the stk banking account card",
        ("assigned credential", 0.4, r"(?:mật khẩu|mat khau|password|mã pin|ma pin|\bpin\b|mã otp|ma otp|\botp\b).{0,60}?(?:là\s*[:]?|[:=])\s*['\"]?[A-Za-z0-9]{4,12}['\"]?", "credential"),
    ),
    rule(
        "VN_NATIONAL_ID", "căn cước cccd cmnd cmtnd định danh chiếu chieu",
        ("12 digits", 0.4, r"\b\d{3}[0-3]\d{8}\b", "8 digits"),
        ("9 digits", 0.15, r"\b\d{9}\b", "8 digits"),
    ),
    rule(
        "PHONE_NUMBER", "điện thoại sđt phone mobile call",
        ("Vietnamese mobile", 0.75, r"\b0[35789]\d{8}\b", "8 digits"),
        ("Vietnamese mobile, international", 0.75, r"(?:\+84|0084)[35789]\d{8}\b", "plus"),
    ),
    rule(
        "BANK_ACCOUNT_NUMBER", "tài khoản stk account chuyển beneficiary iban",
        ("grouped digits", 0.25, r"\b\d{2,4}[.\-]\d{3,4}[.\-]\d{3,6}\b", "dash group"),
        ("bare digits", 0.15, r"\b\d{8,16}\b", "8 digits"),
    ),
    rule(
        "FULL_ADDRESS", "địa chỉ address trụ sở",
        ("numbered, with districts", 0.4, r"\bSố\s+\d+[A-Za-z]?[^\n.;]{0,60}?(?:,\s*(?:phường|xã|thị trấn|quận|huyện|thành phố|tỉnh|tp\.?)\s+[^\n,.;]{2,40}){1,4}", "house"),
    ),
)


def ipv6() -> str:
    """The full grammar of RFC 4291, the longest forms first: eight groups, one '::' anywhere, an IPv4 address at the end."""
    h, dotted = "[0-9a-f]{1,4}", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    forms = [f"(?:{h}:){{6}}{dotted}", f"(?:{h}:){{7}}{h}"]
    for left in range(6, -1, -1):
        head = f"(?:{h}:){{{left - 1}}}{h}" if left else ""
        if left <= 4:
            forms.append(f"{head}::(?:{h}:){{0,{4 - left}}}{dotted}")
        forms.append(f"{head}::{h}(?::{h}){{0,{6 - left}}}")
    forms += [f"(?:{h}:){{{n - 1}}}{h}::" for n in range(7, 0, -1)]
    return r"(?<![\w:.])(?:" + "|".join(forms) + r")(?![\w:]|\.\d)"


IPV6 = ipv6()
# Our own definitions, from public standards, of the general categories.
GENERAL = (
    rule("EMAIL_ADDRESS", "email mail contact", ("dot-atom at domain", 1.0, r"\b[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}\b", "at")),
    rule(
        "PHONE_NUMBER", "phone call mobile tel fax number",
        ("E.164", 0.4, r"\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}\b", "plus"),
        ("national, bracketed", 0.4, r"\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}\b", "bracket"),
        ("national, grouped", 0.4, r"\b\d{3}[ .\-]\d{3}[ .\-]\d{4}\b", "dashed"),
    ),
    rule("URL", "website link url", ("scheme", 0.6, r"\bhttps?://[^\s<>\"']+", "scheme"), ("bare domain", 0.5, r"\b(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+(?:com|org|net|edu|gov|io|info|biz|vn|uk|de|fr|es|br|in|ca|il)\b(?:/[^\s<>\"']*)?")),
    rule(
        "IP_ADDRESS", "ip address server host",
        ("IPv4", 0.6, r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", "dotted"),
        ("IPv6", 0.6, IPV6, "colons"),
    ),
    rule("CREDIT_CARD", "card credit visa mastercard", ("12 to 19 digits", 0.3, r"\b\d(?:[ \-]?\d){11,18}\b", "digit run"), validate=validators.credit_card),
    rule("IBAN_CODE", "iban bank account", ("country, check, account", 0.5, r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}\b"), validate=validators.iban),
    rule("CRYPTO", "wallet btc bitcoin crypto", ("Base58 or Bech32", 0.5, r"\b(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[a-z0-9]{11,71})\b"), validate=validators.crypto),
    rule("MAC_ADDRESS", "mac address hardware", ("six pairs", 0.6, r"\b(?:[0-9A-F]{2}[:\-]){5}[0-9A-F]{2}\b", "pairs")),
    rule("US_SSN", "ssn social security", ("area, group, serial", 0.85, r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}\b", "ssn")),
)
RULES = CUSTOM + GENERAL

# What each type weighs in triage.
SEVERITY = {
    "INFRA_SECRET": ("critical", 3), "CRYPTO_PRIVATE_KEY": ("critical", 3), "FINANCIAL_CREDENTIAL": ("critical", 3),
    "US_SSN": ("critical", 3), "CREDIT_CARD": ("critical", 3), "VN_NATIONAL_ID": ("critical", 3),
    "CONTRACT_ID": ("sensitive", 2), "INTERNAL_TAX_CODE": ("sensitive", 2), "FINANCIAL_METRIC": ("sensitive", 2),
    "EMPLOYEE_ID": ("sensitive", 2), "INFRA_NETWORK_MAP": ("sensitive", 2), "GPS_LOCATION": ("sensitive", 2),
    "IP_SENSITIVE_MARKER": ("review", 1),
}
# Types that flag a sentence's topic, and types a deep scan can produce.
TOPICS = ("HR_SENSITIVE_CONTENT", "IP_TRADE_SECRET_CONTENT")
COMPETING = ("ORGANIZATION", "PERSON", "LOCATION", *sorted({r.entity_type for r in RULES}))
# Points of a score, tokens of context on either side, characters of a snippet, longest text, thresholds.
BOOST, NEIGHBOURS, SNIPPET, LONGEST = 0.35, 8, 40, 50_000
THRESHOLD, CORPUS_THRESHOLD = 0.7, 0.5


def active(rules: tuple[Rule, ...] = RULES, threshold: float = 0.0, types: set[str] | None = None) -> tuple[Rule, ...]:
    """Rules and patterns that can reach the threshold at all; the others never enter a plan."""
    out = []
    for r in rules:
        if types is None or r.entity_type in types:
            keep = tuple(p for p in r.patterns if r.validate or p.score + (BOOST if r.context else 0) >= threshold)
            if keep:
                out.append(Rule(r.entity_type, keep, r.context, r.validate))
    return tuple(out)
