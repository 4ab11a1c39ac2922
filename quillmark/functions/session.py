"""Session functions: values of the engine's session as literals, so plans stay constant-folded."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "quillmark 0.2"


@dataclass
class Session:
    user: str = "reader"
    database: str = "main"
    schema: str = "public"
    settings: dict[str, str] = field(default_factory=lambda: {"timezone": "UTC", "search_path": "public"})

    pid: int = field(default_factory=os.getpid)

    def version_text(self) -> str:
        return VERSION

    def setting(self, name: str, missing_ok: bool = False) -> str | None:
        if name.lower() not in self.settings and not missing_ok:
            raise KeyError(f"no setting {name}")
        return self.settings.get(name.lower())

    def change(self, name: str, value: str, local: bool = False) -> None:
        if local:
            raise ValueError("settings hold for the session")
        self.settings[name.lower()] = value
        if name.lower() == "search_path":
            self.schema = value.split(",")[0].strip()

    def version(self) -> Column:
        return F.lit(VERSION)

    def current_schema(self) -> Column:
        return F.lit(self.schema)

    def current_database(self) -> Column:
        return F.lit(self.database)

    def current_user(self) -> Column:
        return F.lit(self.user)

    session_user = current_role = current_user

    def current_setting(self, name: str, missing_ok: bool = False) -> Column:
        return F.lit(self.setting(name, missing_ok))

    def set_config(self, name: str, value: str, local: bool = False) -> Column:
        self.change(name, value, local)
        return F.lit(value)

    # Constants that clients of the wire protocol ask for.

    def has_privilege(self, *_: object) -> Column:
        return F.lit(True)

    def table_is_visible(self, *_: object) -> Column:
        return F.lit(True)

    def user_by_id(self, *_: object) -> Column:
        return F.lit(self.user)

    def description(self, *_: object) -> Column:
        return F.lit(None).cast("string")

    def encoding_name(self, code: int) -> Column:
        return F.lit("UTF8" if code == 6 else "SQL_ASCII" if code == 0 else "")
