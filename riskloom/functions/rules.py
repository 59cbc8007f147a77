"""Rule packs and the regular-expression dialect they are written in.

Patterns are in RE2 syntax and semantics; :func:`.re2.to_java` turns them into java.util.regex patterns that
match the same strings. What a text must hold for a rule to fire, literals and runs of digits, is derived from
the pattern, of a user's own rules as well: cheap tests that spare the regular expression on most texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .re2 import digit_run, required

SECRETS, INJECTION, PII = "SECRETS", "PROMPT_INJECTION", "PII"
RISKY, EXFIL, MALWARE, OK = "RISKY_OPERATIONS", "DATA_EXFILTRATION", "MALWARE_INTENT", "OK"


#: Shorter runs of digits are in most texts and not looked for.
LEAST_RUN = 4


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    type: str
    detail: str
    severity: str
    confidence: float
    pattern: str
    #: Of each group one literal must occur in the folded text; None: as the pattern says, empty: no such test.
    needs: tuple[tuple[str, ...], ...] | None = None
    #: Digits in a row that every match holds; None: as the pattern says, 0: no such test.
    digits: int | None = None

    @property
    def literals(self) -> tuple[tuple[str, ...], ...]:
        if self.needs is not None:
            return self.needs
        # Where a long run of digits is looked for, single digits say nothing more.
        return tuple(g for g in required(self.pattern) if not (self.run and all(s.isdigit() for s in g)))

    @property
    def run(self) -> int:
        if self.digits is not None:
            return self.digits
        found = digit_run(self.pattern)
        return found if found >= LEAST_RUN else 0

    @property
    def has_span(self) -> bool:
        return self.category in (PII, SECRETS)


# Severities in order, their weights, and the cap of the score.
SEVERITIES = ("low", "medium", "high", "critical")
WEIGHTS = (10, 25, 50, 80)
MAX_SCORE = 100

# Confidences of the packs whose rules share one.
PII_CONFIDENCE, RISKY_CONFIDENCE, EXFIL_CONFIDENCE, MALWARE_CONFIDENCE = 0.85, 0.90, 0.82, 0.90

# The rules, as (id, type, detail, severity, pattern), in evaluation order; for injection also the confidence.
_INJECTION = [
    ("INJ01", "Attempt to override system instructions", "high", 0.88, r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)"),
    ("INJ02", "Disregard instructions attempt", "high", 0.87, r"(?i)disregard\s+(all\s+)?(previous|prior|above|your)\s+(instructions?|guidelines?|rules?)"),
    ("INJ03", "System prompt extraction attempt", "high", 0.85, r"(?i)(reveal|show|display|print|output)\s+.{0,20}\b(system\s*prompt|original\s*instructions?|hidden\s*prompt)\b"),
    ("INJ04", "Jailbreak attempt (DAN-style)", "critical", 0.92, r"(?i)\bact\s*(as|like)\b.{0,30}\b(unrestricted|unfiltered|jailbroken|DAN)\b"),
    ("INJ05", "Attempt to remove restrictions", "high", 0.85, r"(?i)\bpretend\b.{0,30}\b(no\s*rules|no\s*restrictions|unlimited)\b"),
    ("INJ06", "Role override attempt", "high", 0.82, r"(?i)\byou\s*are\s*now\b.{0,30}\b(free|unrestricted|evil|unfiltered)\b"),
    ("INJ07", "Memory/training override attempt", "high", 0.80, r"(?i)\bforget\b.{0,30}\b(everything|all|rules|training|instructions)\b"),
    ("INJ08", "Privilege escalation attempt", "high", 0.88, r"(?i)\b(sudo|admin|root)\s*mode\b"),
    ("INJ09", "Developer mode bypass attempt", "high", 0.85, r"(?i)\bdeveloper\s*mode\b.{0,20}\b(enabled?|on|active|activated)\b"),
    ("INJ10", "System tag injection", "critical", 0.90, r"(?i)\[\s*system\s*\]|\<\s*system\s*\>|##\s*system"),
    ("INJ11", "Code block injection attempt", "medium", 0.75, r"(?i)```\s*(system|instruction|prompt)"),
    ("INJ12", "Instruction extraction attempt", "medium", 0.78, r"(?i)\b(print|output|echo|display)\b.{0,20}\b(instructions?|prompt|rules|guidelines)\b"),
    ("INJ13", "Prompt repetition attack", "medium", 0.80, r"(?i)\brepeat\b.{0,30}\b(above|previous|system)\b.{0,20}\b(text|message|prompt|instructions)\b"),
]
_PII = [
    ("PII01", "US_SSN_EXPLICIT", "SSN with explicit context detected", "critical", r"(?i)(my\s+)?(ssn|social\s*security\s*(number)?)\s*(is|:)\s*\d{3}[-.\s]?\d{2,3}[-.\s]?\d{4}"),
    ("PII02", "US_SSN", "US Social Security Number format detected", "critical", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("PII03", "VISA_CARD", "Visa credit card number detected", "critical", r"\b4[0-9]{12}(?:[0-9]{3})?\b"),
    ("PII04", "MASTERCARD", "Mastercard number detected", "critical", r"\b5[1-5][0-9]{14}\b"),
    ("PII05", "AMEX_CARD", "American Express card detected", "critical", r"\b3[47][0-9]{13}\b"),
    ("PII06", "CREDIT_CARD_16", "16-digit card number detected", "critical", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("PII07", "ID_DOCUMENT", "Identity document number detected", "high", r"(?i)\b(passport|license|licence)\s*(number|no|#|num)\.?\s*:?\s*[A-Z0-9]{6,12}\b"),
    ("PII08", "UK_NINO", "UK National Insurance Number detected", "critical", r"\b[A-Z]{2}\d{6}[A-Z]?\b"),
    ("PII09", "PHONE_NUMBER", "Phone number detected", "medium", r"\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("PII10", "EMAIL_PERSONAL", "Personal email shared", "medium", r"(?i)(my|personal|private)\s+email\s*(is|:)\s*[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
]
_RISKY = [
    ("OPS01", "RM_RF_ROOT", "Recursive force delete from root", "critical", r"(?i)\brm\s+-r?f\s+/"),
    ("OPS02", "RM_RF", "Recursive force delete command", "high", r"(?i)\brm\s+-rf\b"),
    ("OPS03", "FORMAT_DISK", "Disk format command detected", "critical", r"(?i)\bmkfs\b"),
    ("OPS04", "DD_OVERWRITE", "Direct disk overwrite via dd", "critical", r"(?i)\bdd\s+if=.+of=/dev/"),
    ("OPS05", "DROP_DB", "DROP DATABASE/TABLE command detected", "critical", r"(?i)\bDROP\s+(DATABASE|TABLE|SCHEMA)\b"),
    ("OPS06", "TRUNCATE_TABLE", "TRUNCATE TABLE command detected", "high", r"(?i)\bTRUNCATE\s+TABLE\b"),
    ("OPS07", "DELETE_ALL", "DELETE all rows detected", "high", r"(?i)\bDELETE\s+FROM\b.{0,20}\bWHERE\s+1\s*=\s*1\b"),
    ("OPS08", "CHMOD_777", "World-writable permissions", "high", r"(?i)\bchmod\s+777\b"),
    ("OPS09", "CHMOD_OPEN", "Overly permissive chmod", "high", r"(?i)\bchmod\s+[0-7]*777\b"),
    ("OPS10", "CHOWN_ROOT", "Changing ownership to root", "medium", r"(?i)\bchown\s+root\b"),
    ("OPS11", "KILL_ALL", "Kill all processes", "critical", r"(?i)\bkill\s+-9\s+-1\b"),
    ("OPS12", "KILLALL", "Kill all by name", "high", r"(?i)\bkillall\b"),
    ("OPS13", "SHUTDOWN", "System shutdown/reboot command", "high", r"(?i)\bshutdown\b|\breboot\b|\bhalt\b"),
    ("OPS14", "FLUSH_IPTABLES", "Flush firewall rules", "critical", r"(?i)\biptables\s+-F\b"),
    ("OPS15", "DISABLE_UFW", "Disable UFW firewall", "high", r"(?i)\bufw\s+disable\b"),
    ("OPS16", "DISABLE_SELINUX", "Disable SELinux", "high", r"(?i)\bsetenforce\s+0\b"),
    ("OPS17", "REG_DELETE", "Windows registry delete", "high", r"(?i)\breg\s+delete\b"),
    ("OPS18", "FORMAT_DRIVE", "Format Windows drive", "critical", r"(?i)\bformat\s+[A-Z]:\b"),
]
_EXFIL = [
    ("EXF01", "BULK_EXTRACT", "Bulk data extraction attempt", "high", r"(?i)\b(dump|export|extract|download)\s+(all|every|entire)\s+(customer|user|employee|patient|record|data)"),
    ("EXF02", "PII_DUMP", "Attempt to dump PII fields", "critical", r"(?i)\b(list|show|give|send)\s+(me\s+)?(all|every)\s+(user|customer|employee|patient)s?\b.{0,30}\b(password|email|ssn|salary|address|phone)"),
    ("EXF03", "DB_DUMP_CMD", "Database dump command detected", "high", r"(?i)\bmysqldump\b|\bpg_dump\b|\bmongodump\b"),
    ("EXF04", "SELECT_STAR_SENSITIVE", "SELECT * from sensitive table", "high", r"(?i)\bSELECT\s+\*\s+FROM\b.{0,30}\b(user|customer|employee|patient|account|credential)"),
    ("EXF05", "BULK_REPORT", "Bulk report generation attempt", "medium", r"(?i)\b(generate|create|make)\s+(a\s+)?(csv|spreadsheet|report)\s+(of|with|containing)\s+(all|every)"),
    ("EXF06", "DATA_SCRAPING", "Data scraping attempt", "high", r"(?i)\b(scrape|crawl|harvest)\s+(all|every|the\s+entire)"),
]
_MALWARE = [
    ("MAL01", "KEYLOGGER", "Keylogger creation request", "critical", r"(?i)\b(write|create|build|make|code|generate)\s+(a\s+|me\s+)?(keylogger|key\s*logger)"),
    ("MAL02", "PHISHING", "Phishing tool creation request", "critical", r"(?i)\b(write|create|build|make|generate)\s+(a\s+|me\s+)?(phishing|fake\s+login|credential\s*harvester)"),
    ("MAL03", "RANSOMWARE", "Ransomware creation request", "critical", r"(?i)\b(write|create|build|make|generate)\s+(a\s+|me\s+)?(ransomware|crypto\s*locker|file\s*encryptor\s+.{0,20}ransom)"),
    ("MAL04", "MALWARE_GENERIC", "Malware creation request", "critical", r"(?i)\b(write|create|build|make|generate)\s+(a\s+|me\s+)?(virus|worm|trojan|malware|spyware|rootkit)"),
    ("MAL05", "REVERSE_SHELL", "Reverse shell request", "critical", r"(?i)\breverse\s*shell\b"),
    ("MAL06", "EXPLOIT_CODE", "Exploit code request", "critical", r"(?i)\b(buffer\s*overflow|heap\s*spray|use.after.free)\s*(exploit|attack|payload)"),
    ("MAL07", "WEB_EXPLOIT", "Web exploit creation request", "high", r"(?i)\b(sql\s*injection|xss|cross.site)\s*(attack|payload|exploit|script)\b"),
    ("MAL08", "DDOS_TOOL", "DDoS tool request", "critical", r"(?i)\bDDoS\b.{0,20}\b(tool|script|attack|bot)"),
    ("MAL09", "PASSWORD_CRACK", "Password cracking tool request", "high", r"(?i)\b(crack|brute\s*force|hash\s*cat|john\s+the\s+ripper)\b.{0,20}\b(password|credential|hash)"),
]

def _pack(category: str, confidence: float, rows: list[tuple[str, str, str, str, str]]) -> list[Rule]:
    return [Rule(i, category, t, d, s, confidence, p) for i, t, d, s, p in rows]


INJECTION_PACK = [Rule(i, INJECTION, "INJECTION_PATTERN", d, s, c, p) for i, d, s, c, p in _INJECTION]
PII_PACK = _pack(PII, PII_CONFIDENCE, _PII)
RISKY_PACK = _pack(RISKY, RISKY_CONFIDENCE, _RISKY)
EXFIL_PACK = _pack(EXFIL, EXFIL_CONFIDENCE, _EXFIL)
MALWARE_PACK = _pack(MALWARE, MALWARE_CONFIDENCE, _MALWARE)

#: The default rules, in detector order; a secrets pack would come first.
VISIBLE_RULES: list[Rule] = INJECTION_PACK + PII_PACK + RISKY_PACK + EXFIL_PACK + MALWARE_PACK

#: An optional pack of our own: common credential shapes. It claims no parity with any other engine's rules.
SECRETS_PACK: list[Rule] = [
    Rule(i, SECRETS, t, d, "critical", 0.95, p)
    for i, t, d, p in [
        ("SEC01", "PROVIDER_KEY", "Provider API key detected", r"\bsk-[A-Za-z0-9_-]{16,}"),
        ("SEC02", "AWS_ACCESS_KEY", "AWS access key id detected", r"\bAKIA[A-Z0-9]{16}\b"),
        ("SEC03", "GITHUB_TOKEN", "GitHub token detected", r"\bgh[pousr]_[A-Za-z0-9]{36}"),
        ("SEC04", "API_KEY_ASSIGNMENT", "API key assignment detected", r"(?i)\b(api_?key|secret|token|password)\b\s*[:=]\s*[^\s]{8,}"),
        ("SEC05", "PRIVATE_KEY", "Private key block detected", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
        ("SEC06", "URL_CREDENTIALS", "Credentials in a URL detected", r"(?i)[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s/]+@"),
        ("SEC07", "BEARER_TOKEN", "Bearer token detected", r"(?i)\bbearer\s+[a-z0-9_-]+\.[a-z0-9_-]+\.[a-z0-9_-]+"),
    ]
]
PACKS: dict[str, list[Rule]] = {"visible": VISIBLE_RULES, "visible+secrets": SECRETS_PACK + VISIBLE_RULES}

def rule_named(rule_id: str) -> Rule:
    return next(r for r in PACKS["visible+secrets"] if r.id == rule_id)


#: What a policy annotation looks like: ``@Policy(profile="strict", block=true, rewrite=false, remote="http://..")``.
ANNOTATION = re.compile(r"@Policy\(([^)]+)\)")
SETTING = re.compile(r'(\w+)\s*=\s*(?:"([^"]+)"|(true|false))')


def parse_annotation(text: str) -> dict[str, str]:
    """Settings of the first ``@Policy(...)`` in a comment; empty if there is none."""
    found = ANNOTATION.search(text or "")
    return {k: a or b for k, a, b in SETTING.findall(found[1])} if found else {}
