"""Scan settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pagescan import catalog

SCOPE_DOMAIN, SCOPE_EXTERNAL_ONCE, SCOPE_ALL, SCOPE_WHITELIST = 0, 1, 2, 3

# Names a JSON settings file uses, where they differ from the field names.
_JSON_NAMES = {
    "url_scope_mode": "scope_mode",
    "danger_api_list": "danger_keywords",
    "danger_filter_enabled": "danger_filter",
    "custom_base_url": "custom_base_urls",
    "path_route": "path_routes",
    "api_route": "api_routes",
}


@dataclass(frozen=True)
class ScanOptions:
    """What to keep, how far to walk and what to look for.

    ``scope_mode``: 0 target domain only; 1 target domain, other domains once
    without following them; 2 everything; 3 white-listed domains only.
    An empty ``extension_blacklist`` means the default list.
    ``max_urls=None``: no budget; with one, URLs past it become error rows.
    ``public_suffixes=None`` compares host names instead of registered domains.
    ``signature``: ``length_status`` or ``content``.
    ``sample_mode``: ``findall`` reports what the groups of a rule captured,
    ``match`` the whole matched text.
    ``danger_label_ignores_case=False`` labels danger links by a
    case-sensitive test, so a link caught through other case reads "unknown".
    """

    scope_mode: int = SCOPE_DOMAIN
    blacklist_domains: tuple[str, ...] = ()
    whitelist_domains: tuple[str, ...] = ()
    extension_blacklist: tuple[str, ...] = ()
    danger_filter: bool = True
    danger_keywords: tuple[str, ...] = tuple(catalog.DANGER_KEYWORDS)
    danger_label_ignores_case: bool = True
    fuzz: bool = False
    custom_base_urls: tuple[str, ...] = ()
    path_routes: tuple[str, ...] = ()
    api_routes: tuple[str, ...] = ()
    max_depth: int = 1
    max_urls: int | None = None
    share_visited: bool = True
    public_suffixes: tuple[str, ...] | None = tuple(catalog.PUBLIC_SUFFIXES)
    signature: str = "length_status"
    dedup_errors: bool = True
    sample_mode: str = "findall"

    def __post_init__(self):
        for field in fields(self):
            value = getattr(self, field.name)
            if isinstance(value, (list, set)):
                object.__setattr__(self, field.name, tuple(value))
        if self.scope_mode not in (0, 1, 2, 3):
            raise ValueError(f"scope_mode must be 0, 1, 2 or 3, not {self.scope_mode!r}")
        if self.signature not in ("length_status", "content"):
            raise ValueError(f"unknown signature {self.signature!r}")
        if self.sample_mode not in ("findall", "match"):
            raise ValueError(f"unknown sample_mode {self.sample_mode!r}")

    @property
    def extensions(self) -> tuple[str, ...]:
        return self.extension_blacklist or tuple(catalog.DEFAULT_EXTENSIONS)

    @property
    def active_danger_keywords(self) -> tuple[str, ...]:
        return self.danger_keywords if self.danger_filter else ()

    @classmethod
    def from_json(cls, text: str) -> "ScanOptions":
        """Options from a JSON settings file; keys about fetching are ignored.

        A file leaves more out than a plain constructor call does: depth and
        extensions then start from the file defaults.
        """
        settings = {
            "max_depth": catalog.SETTINGS_MAX_DEPTH,
            "extension_blacklist": catalog.SETTINGS_EXTENSIONS,
        }
        for key, value in json.loads(text).items():
            if value is not None:
                settings[_JSON_NAMES.get(key, key)] = value
        for flag in ("danger_filter", "fuzz"):
            if flag in settings:
                settings[flag] = bool(int(settings[flag]))
        if "scope_mode" in settings:
            settings["scope_mode"] = int(settings["scope_mode"])
        for name in ("custom_base_urls", "path_routes", "api_routes"):
            if isinstance(settings.get(name), str):
                settings[name] = (settings[name],)
        known = {field.name for field in fields(cls)}
        return cls(**{key: value for key, value in settings.items() if key in known})
