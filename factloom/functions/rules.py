"""The catalogue of pattern rules: what a match in a file says.

A payload's value is made of a match's groups: a number is the group without quotes, ("upper", n) its upper case, ("lower", n)
its lower case, ("list", n) its quoted items in upper case, ("text", n) the group with single blanks; anything else is itself.
A second element after ("upper", n, default) stands where the group is missing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    file: str
    pattern: str
    payload: tuple[tuple[str, Any], ...]
    flags: int = re.IGNORECASE


def _rule(id_: str, kind: str, file: str, pattern: str, flags: int = re.IGNORECASE, /, **payload: Any) -> Rule:
    return Rule(id_, kind, file, pattern, tuple(payload.items()), flags)


JS, TS, JSX, JAVA, JAVA_XML, PY, CS = r"\.[cm]?[jt]s$", r"\.ts$", r"\.[jt]sx?$", r"\.java$", r"\.(?:java|xml)$", r"\.py$", r"\.cs$"

# Files, patterns and payloads of the rules.
RULES = (
    _rule("express.route", "http_endpoint_fragment", JS, r"\b(app|router)\s*\.\s*(get|post|put|patch|delete|options|head)\s*\(\s*([\"'`][^\"'`]+[\"'`])\s*,\s*([\s\S]{1,500}?)\)\s*;",
          framework="express", receiver=("lower", 1), method=("upper", 2), path=3, handler_expression=("text", 4), route_scope=("scope", 1)),
    _rule("express.mount", "http_route_mount", JS, r"\bapp\s*\.\s*use\s*\(\s*([\"'`][^\"'`]+[\"'`])\s*,\s*([A-Za-z_$][\w$]*)", framework="express", path=1, router_symbol=2),
    _rule("node.fetch.static", "http_client_call", JS, r"\bfetch\s*\(\s*([\"'`][^\"'`]+[\"'`])(?:\s*,\s*\{[\s\S]{0,300}?method\s*:\s*([\"'][A-Z]+[\"']))?", library="fetch", method=("upper", 2, "GET"), path_expression=1),
    _rule("node.fetch.symbolic", "http_client_call", JS, r"\bfetch\s*\(\s*([A-Za-z_$][\w$]*)", library="fetch", method="UNKNOWN", path_expression=1, resolved=False),
    _rule("supabase.entity", "data_entity", JS, r"\.from\s*\(\s*([\"'][^\"']+[\"'])\s*\)", provider="supabase", entity=1),
    _rule("supabase.read", "data_read", JS, r"\.from\s*\(\s*([\"'][^\"']+[\"'])\s*\)[\s\S]{0,500}?\.select\s*\(", provider="supabase", resource=1, operation="select"),
    _rule("supabase.write", "data_write", JS, r"\.from\s*\(\s*([\"'][^\"']+[\"'])\s*\)[\s\S]{0,500}?\.(insert|update|upsert|delete)\s*\(", provider="supabase", resource=1, operation=("lower", 2)),
    _rule("python.fastapi.decorator", "http_endpoint", PY, r"@(?:app|router)\.(get|post|put|patch|delete|options|head)\(\s*([rubf]*[\"'][^\"']+[\"'])", framework="fastapi", method=("upper", 1), path=2),
    _rule("python.flask.route", "http_endpoint", PY, r"@(?:app|blueprint|bp)\.route\(\s*([rubf]*[\"'][^\"']+[\"'])(?:\s*,\s*methods\s*=\s*\[([^\]]+)\])?", framework="flask", method=("list", 2, "GET"), path=1),
    _rule("python.django.path", "ui_or_http_route", r"urls\.py$", r"\b(?:path|re_path)\(\s*([rubf]*[\"'][^\"']+[\"'])\s*,\s*([A-Za-z_][\w.]*)", framework="django", path=("rooted", 1), handler=2, method="unknown"),
    _rule("python.httpx.base_url", "http_client_base", PY, r"httpx\.(?:Client|AsyncClient)\([^)]*?base_url\s*=\s*([\"'][^\"']+[\"'])", library="httpx", base_url=1, resolved=False),
    _rule("python.http.client_call", "http_client_call", PY, r"\b([A-Za-z_]\w*)\.(get|post|put|patch|delete)\(\s*([furb]*[\"'][^\"']+[\"'])", client=1, method=("upper", 2), path_expression=3),
    _rule("python.manifest.dependency", "package_dependency", r"(?:requirements[^/]*\.txt|pyproject\.toml)$", r"^\s*([A-Za-z0-9_.-]+)(?:\[[^\]]+\])?\s*(?:[=<>~!^].*)?$", re.IGNORECASE | re.MULTILINE, package=1, declared=True),
    _rule("dotnet.controller.route", "http_endpoint_fragment", CS, r"\[(HttpGet|HttpPost|HttpPut|HttpPatch|HttpDelete)(?:\(\s*([\"'][^\"']*[\"'])\s*\))?\]", framework="aspnet", method=("verb", 1), path=2, route_scope="method"),
    _rule("dotnet.controller.prefix", "http_route_prefix", CS, r"\[Route\(\s*([\"'][^\"']+[\"'])\s*\)\]", framework="aspnet", path=1),
    _rule("dotnet.minimal.api", "http_endpoint", CS, r"\b(?:app|group)\.Map(Get|Post|Put|Patch|Delete)\(\s*([\"'][^\"']+[\"'])", framework="aspnet-minimal", method=("upper", 1), path=2),
    _rule("dotnet.httpclient.base", "http_client_base", CS, r"BaseAddress\s*=\s*new\s+Uri\(\s*([\"'][^\"']+[\"'])", library="HttpClient", base_url=1, resolved=False),
    _rule("dotnet.ef.dbset", "data_entity", CS, r"DbSet<([^>]+)>\s+([A-Za-z_]\w*)", orm="entity-framework", entity=1, set=2),
    _rule("dotnet.csproj.package", "package_dependency", r"\.csproj$", r"<PackageReference\s+Include=[\"']([^\"']+)[\"'](?:\s+Version=[\"']([^\"']+)[\"'])?", package=1, declared_version=2),
    _rule("angular.route", "ui_route", TS, r"\{\s*path\s*:\s*([\"'][^\"']*[\"'])\s*,\s*(?:component|loadComponent|loadChildren)\s*:", framework="angular", path=1, backend_endpoint=False),
    _rule("angular.httpclient", "http_client_call", TS, r"\b(?:this\.)?http\.(get|post|put|patch|delete)\s*(?:<[^>]+>)?\(\s*([`\"'][^`\"']+[`\"'])", library="angular-http-client", method=("upper", 1), path_expression=2),
    _rule("angular.component", "ui_component", r"\.component\.ts$", r"@Component\s*\(\s*\{[\s\S]*?selector\s*:\s*([\"'][^\"']+[\"'])", framework="angular", selector=1),
    _rule("angular.environment", "http_client_base", r"environment[^/]*\.ts$", r"\b(apiUrl|baseUrl|endpoint)\s*:\s*([`\"'][^`\"']+[`\"'])", name=1, base_url=2),
    _rule("angular.package", "package_dependency", r"package\.json$", r"[\"'](@angular/[^\"']+)[\"']\s*:\s*[\"']([^\"']+)[\"']", package=1, declared_version=2),
    _rule("react.router.route", "ui_route", JSX, r"<Route\b[^>]*\bpath\s*=\s*(?:\{)?([\"'][^\"']+[\"'])", framework="react-router", path=1, backend_endpoint=False),
    _rule("react.fetch", "http_client_call", r"\.[jt]sx$", r"\bfetch\(\s*([`\"'][^`\"']+[`\"'])(?:\s*,\s*\{[\s\S]{0,300}?method\s*:\s*([\"'][A-Z]+[\"']))?", library="fetch", method=("upper", 2, "GET"), path_expression=1),
    _rule("react.axios", "http_client_call", JSX, r"\baxios\.(get|post|put|patch|delete)\(\s*([`\"'][^`\"']+[`\"'])", library="axios", method=("upper", 1), path_expression=2),
    _rule("react.component", "ui_component", r"\.[jt]sx$", r"(?:function|const)\s+([A-Z][A-Za-z0-9_]*)\s*(?:\([^)]*\)|=)[\s\S]{0,200}?(?:return\s*\(|=>\s*\(?\s*<)", framework="react", name=1),
    _rule("jee.jaxrs.path", "http_endpoint_fragment", JAVA, r"@(GET|POST|PUT|PATCH|DELETE)\b[\s\S]{0,300}?@Path\(\s*([\"'][^\"']+[\"'])\s*\)", framework="jax-rs", method=("upper", 1), path=2, route_scope="unknown"),
    _rule("jee.ejb", "jee_component", JAVA, r"@(Stateless|Stateful|Singleton)\b[\s\S]{0,200}?class\s+([A-Za-z_]\w*)", type=("lower", 1), name=2),
    _rule("jee.jms.destination", "message_resource", JAVA_XML, r"(?:destinationLookup\s*=\s*[\"']|<destination-jndi-name>)([^\"'<]+)(?:[\"']|</destination-jndi-name>)", broker="jms", destination=1),
    _rule("jee.jndi", "jndi_resource", JAVA_XML, r"(?:lookup\s*=\s*[\"']|<jndi-name>)([^\"'<]+)(?:[\"']|</jndi-name>)", name=1, resolved=False),
    _rule("jee.module", "deployment_module", r"(?:application|web|weblogic)\.xml$", r"<(web-uri|ejb|context-root)>([^<]+)</(?:web-uri|ejb|context-root)>", kind=1, value=2, declared=True),
    _rule("spring.feign.client", "http_client_base", JAVA, r"@FeignClient\s*\([^)]*?(?:url\s*=\s*)?([\"'][^\"']+[\"'])", library="feign", base_url=1),
    _rule("spring.jpa.entity", "data_entity", JAVA, r"@Entity\b[\s\S]{0,500}?\bclass\s+([A-Za-z_]\w*)", orm="jpa", entity=1),
    _rule("spring.kafka.listener", "message_consumer", JAVA, r"@KafkaListener\s*\([^)]*?topics\s*=\s*([\"'][^\"']+[\"'])", broker="kafka", topic=1),
    _rule("spring.pom.dependency", "package_dependency", r"pom\.xml$", r"<dependency>[\s\S]*?<groupId>([^<]+)</groupId>[\s\S]*?<artifactId>([^<]+)</artifactId>[\s\S]*?</dependency>", package=("joined", 1, 2), declared=True),
    _rule("webflux.webclient", "http_client_call", JAVA, r"\.(get|post|put|patch|delete)\(\)\s*\.uri\(\s*([^,)]+)", library="webclient", method=("upper", 1), uri_expression=2),
)


def unquoted(value: str | None) -> str | None:
    """Without a string's prefix and quotes."""
    if value is None:
        return None
    bare = re.sub(r"^[rubf]+(?=[\"'])", "", value.strip(), flags=re.IGNORECASE)
    return bare[1:-1] if len(bare) > 1 and bare[0] == bare[-1] and bare[0] in "\"'`" else bare


def _made(spec: Any, m: re.Match) -> Any:
    if isinstance(spec, bool) or isinstance(spec, str):
        return spec
    if isinstance(spec, int):
        return unquoted(m[spec])
    how, group, *rest = spec
    value = unquoted(m[group])
    if how == "joined":
        return f"{(m[group] or 'unknown').strip()}:{(m[rest[0]] or 'unknown').strip()}"
    if value is None:
        return [rest[0]] if how == "list" else rest[0] if rest else None
    if how == "upper":
        return value.upper()
    if how == "lower":
        return value.lower()
    if how == "verb":
        return value[4:].upper()
    if how == "list":
        return [re.sub(r"[\"'\s]", "", x).upper() for x in value.split(",")]
    if how == "rooted":
        return re.sub("/+", "/", f"/{value}")
    if how == "scope":
        return "application" if value.lower() == "app" else "router"
    return re.sub(r"\s+", " ", m[group]).strip()


def payload(rule: Rule, m: re.Match) -> dict[str, Any]:
    return {k: v for k, spec in rule.payload if (v := _made(spec, m)) is not None}


_compiled: dict[str, tuple[re.Pattern, re.Pattern]] = {}


def matches(rule: Rule, path: str, text: str):
    """The rule's matches in a file; none in a file that isn't its own."""
    if rule.id not in _compiled:
        _compiled[rule.id] = re.compile(rule.file, re.IGNORECASE), re.compile(rule.pattern, rule.flags | re.ASCII)
    file, pattern = _compiled[rule.id]
    return pattern.finditer(text) if file.search(path) else ()
