"""Settings of the engine: thresholds, and the word lists that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values. They must hold these entries, in this order, for results to agree.

IMPLEMENTATION_INDICATORS = (
    "kubectl", "docker", "compose", "helm", "apply -f", "systemctl", "service", "install ", "pip install", "npm install", "sh ",
    "bash ", "curl ", ".yaml", ".yml", "deployment.yaml", "step ", "1.", "2.", "run ", "execute ", "sudo ",
)
CONCEPTUAL_SECTIONS = ("overview", "architecture", "data flow", "monitoring", "risks", "faqs")
EVIDENCE_KEYWORDS = (
    "connection pool", "connection pool exhausted", "connection refused", "timeout", "deadlock", "out of connections", "db", "database",
    "sql", "connection leak", "max_connections", "too many connections",
)
PROTECTED_KEYWORDS = (
    "critical failure", "failure", "failures", "rollback", "rollback plan", "restore", "recovery", "recovery procedure", "backup",
    "backup strategy", "security", "vulnerability", "breach", "incident response",
)
CAUSAL_PATTERN = r"\b(when|because|due to|caused by|after|once|as a result|lead to|leads to)\b"
# "as i said" is not among them: the comparison is with lower-cased text and a capital I.
REFERENTIAL_PATTERNS = (
    r"\bas i mentioned\b", r"\bas noted earlier\b", r"\bas stated earlier\b", r"\bthis connects to\b", r"\bsee above\b",
    r"\brefer to the previous\b", r"\b(as described|as explained) earlier\b",
)
#: A text that one of the patterns is in has one of these.
REFERENTIAL_WORDS = ("as i mentioned", "earlier", "this connects to", "see above", "refer to the previous")
COMPONENT_PATTERNS = (
    ("grafana", "grafana|dashboard"),
    ("jenkins", "jenkins|build|pipeline"),
    ("kubernetes", "kubernetes|k8s|kubectl|dashboard"),
    ("github", "github|repository|repo"),
    ("aws", "aws|console|ec2|s3|cloudwatch"),
    ("datadog", "datadog|monitoring"),
)
FLOW_BUCKETS = (
    ("System Overview", ("overview", "system", "summary", "introduction", "context")),
    ("Architecture Components", ("arch", "architecture", "component", "service")),
    ("Data Flow", ("flow", "data flow", "pipeline", "request", "message", "event")),
    ("Deployment Process", ("deploy", "deployment", "kubernetes", "kubectl", "helm", "docker", "ci/cd")),
    ("Monitoring Strategy", ("monitor", "monitoring", "metrics", "alert", "logging", "tracing")),
    ("Known Issues", ("issue", "problem", "error", "fail", "bug", "troubleshoot", "troubleshooting")),
)
PHRASE_PATTERNS = (
    (r"pay[\s-]?bin\s+orchestration", "payment orchestration"),
    (r"pay[\s-]?bin\s+process", "payment process"),
    (r"devons", "dev environments"),
    (r"dev\s+dev", "dev"),
    (r"broad\s+staging", "prod staging"),
    (r"qbritis", "kubernetes"),
    (r"cubernetes", "kubernetes"),
    (r"cubernetis", "kubernetes"),
    (r"terra[\s-]?form?\s+state", "terraform state"),
    (r"flash\s+sales", "flash sales"),
    (r"flash\s+sale[\s-]?event", "flash sale event"),
    (r"soby\s+cautious", "so be cautious"),
    (r"season\s+sales", "flash sales"),
    (r"teleform", "terraform"),
    (r"ter[\s-]?form", "terraform"),
    (r"csd\s+pipeline", "ci/cd pipeline"),
    (r"csd\s+tool", "ci/cd tool"),
    (r"hel[\s-]?checks", "health checks"),
    (r"redowning", "redeploying"),
    (r"redone", "red zone"),
    (r"ash-skin", "as-is"),
    (r"understandable\s+back", "understand back"),
    (r"asclicion", "escalation"),
    (r"katie", "KT"),
    (r"katie\s+planner", "KT Planner"),
    (r"continue", ""),
    (r"right[\.,]?\s*$", ""),
    (r"okay[\.,]?\s*$", ""),
    (r"k[\s-]?8[\s-]?s", "kubernetes"),
    (r"a[\s-]?w[\s-]?s", "aws"),
    (r"s[\s-]?r[\s-]?e", "sre"),
    (r"g[\s-]?c[\s-]?p", "gcp"),
    (r"is\s+done", "goes down"),
    (r"what\s+breaks", "what breaks"),
)
WORD_CORRECTIONS = (
    ("qbritis", "kubernetes"), ("cubernetes", "kubernetes"), ("cubernetis", "kubernetes"), ("teleform", "terraform"),
    ("devons", "dev environments"), ("redowning", "redeploying"), ("redone", "red zone"), ("seekers", "secrets"),
    ("asclicion", "escalation"), ("katie", "KT"), ("pay-bin", "payment"), ("paybin", "payment"), ("soby", "so be"),
    ("understandable", "understand"), ("hel", "health"), ("grounding", "grounding"), ("flashsale", "flash sale"),
    ("flashsales", "flash sales"),
)
CONTEXT_RULES = (
    (r"kubernetes|k8s|docker|container", (("qbritis", "kubernetes"), ("cubernetis", "kubernetes"))),
    (r"aws|cloud provider", (("a w s", "aws"),)),
)
GLOSSARY_TERMS = ("Kafka", "Kubernetes", "Grafana", "Prometheus", "REST", "API", "CI/CD", "async", "streaming", "service", "services")
GLOSSARY_PHRASES = (
    ("coffee for a sink event screaming between surfaces", "Kafka for async event streaming between services"),
    ("coffee for a sink", "Kafka for async"),
    ("screaming", "streaming"),
    ("surfaces", "services"),
)
GLOSSARY_ACRONYMS = (("api", "API"), ("rest", "REST"), ("ci cd", "CI/CD"))
AMBIGUOUS_NEARBY = ("customer", "interaction", "physical", "bucket", "container", "box", "person", "human", "client")
QUALITY_TERMS = ("kubernetes", "docker", "aws", "jenkins", "terraform")
MODEL_ACCURACY = (("tiny", 0.85), ("base", 0.90), ("small", 0.92), ("medium", 0.94), ("large", 0.96))
CLAUSE_CONJUNCTIONS = ("and", "but", "however", "also", "in addition", "furthermore", "moreover", "meanwhile", "while")
CONNECTORS = (
    ("however|but|yet|although", "However,"),
    ("furthermore|also|in addition", "Furthermore,"),
    ("because|since|due to", "Because"),
    ("therefore|thus|as a result", "As a result,"),
)
OTHER_CONNECTOR = "Additionally,"


@dataclass(frozen=True)
class Policy:
    confidence_accept_threshold: float = 0.8
    implementation_indicators: tuple[str, ...] = IMPLEMENTATION_INDICATORS
    conceptual_sections: tuple[str, ...] = CONCEPTUAL_SECTIONS


@dataclass(frozen=True)
class Glossary:
    terms: tuple[str, ...] = GLOSSARY_TERMS
    phrase_corrections: tuple[tuple[str, str], ...] = GLOSSARY_PHRASES
    acronyms: tuple[tuple[str, str], ...] = GLOSSARY_ACRONYMS


@dataclass(frozen=True)
class Section:
    """A section of the schema. `text` is what sentences are compared with; `fields` are the form fields."""

    section_ord: int
    section_id: str
    title: str
    required: bool = True
    description: str = ""
    hints: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    fields: tuple[dict, ...] = field(default=(), hash=False)

    @property
    def text(self) -> str:
        return f"{self.title} {self.description} {' '.join(self.hints)}"


@dataclass(frozen=True)
class Scoring:
    """Weights of classification."""

    alpha: float = 0.7
    beta: float = 0.3
    context: int = 3
    boost_step: float = 0.05
    boost_most: float = 0.3
    similarity_threshold: float = 0.30
    top_k: int = 3
