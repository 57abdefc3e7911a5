"""The rules' settings. A YAML file may override them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# The names and tokens below are part of the rules' definition.
BLACKLIST = ("Notes", "Reference", "References", "Ref", "Ref.", "Note", "Remarks", "Remarks/Notes", "Remarks/Note", "Remarks/Ref.", "Reference/Note", "No.")
NULL_TOKENS = ("—", "-", "none", "–")
DATE_FORMATS = ("%d %b", "%d %B", "%d/%m/%Y", "%Y-%m-%d", "%b %d %Y", "%d-%m-%Y", "%m/%d/%Y", "%d %b %Y", "%b %Y", "%B %Y", "%B %d %Y", "%B %d", "%b %d", "%d %B %Y")
STYLE_MARK = "∫"
LINK_MARK = "∟"


# The names of a nested settings file and the fields they set; the marks are the library's own.
NESTED = {
    "special_chars.link_char": "", "special_chars.style_char": "", "remove_data_different_style_from_headers": "strip_header_style", "drop_columns_blacklist": "blacklist",
    "null_chars": "null_tokens", "drop_table_on_column_removal": "drop_table_with_column", "maximum_row_null_values.type": "row_null_mode", "maximum_row_null_values.value": "row_null_value",
    "maximum_column_null_values.type": "column_null_mode", "maximum_column_null_values.value": "column_null_value", "last_row_agg_mechanism": "drop_last_aggregate_row",
    "only_ascii_chars": "only_ascii", "known_dates_format": "date_formats", "minimum_table_size.rows": "min_rows", "minimum_table_size.columns": "min_columns",
    "header_manipulations.remove_data_inside_parentheses": "strip_header_parentheses", "header_manipulations.remove_data_inside_square_brackets": "strip_header_brackets",
    "cell_manipulations.remove_data_inside_parentheses": "strip_cell_parentheses", "cell_manipulations.remove_data_inside_square_brackets": "strip_cell_brackets",
    "maximum_mixed_types.type": "mixed_mode", "maximum_mixed_types.value": "mixed_value",
}


@dataclass(frozen=True)
class Rules:
    blacklist: tuple[str, ...] = BLACKLIST
    null_tokens: tuple[str, ...] = NULL_TOKENS
    date_formats: tuple[str, ...] = DATE_FORMATS
    min_rows: int = 8
    min_columns: int = 2
    only_ascii: bool = True
    strip_cell_parentheses: bool = True
    strip_cell_brackets: bool = True
    strip_header_parentheses: bool = False
    strip_header_brackets: bool = True
    strip_header_style: bool = False
    drop_last_aggregate_row: bool = True
    drop_table_with_column: bool = True
    mixed_mode: str = "abs"
    mixed_value: float = 3
    row_null_mode: str = "percent"
    row_null_value: float = 0.8
    column_null_mode: str = "percent"
    column_null_value: float = 0.4

    @classmethod
    def from_yaml(cls, path: str) -> Rules:
        """Settings from a YAML mapping of this class's fields, or of the nested names in NESTED; unknown names are an error."""
        import yaml

        with open(path) as f:
            found = yaml.safe_load(f) or {}
        flat: dict = {}
        wrong = []
        known = {f.name for f in fields(cls)}
        for name, value in found.items():
            inner = value if isinstance(value, dict) else {"": value}
            for part, v in inner.items():
                place = NESTED.get(f"{name}.{part}".rstrip("."), name if name in known and not part else None)
                if place is None:
                    wrong.append(f"{name}.{part}".rstrip("."))
                elif place:
                    flat[place] = tuple(dict.fromkeys(v)) if isinstance(v, list) else v
        if wrong:
            raise ValueError(f"unknown settings: {sorted(wrong)}")
        return replace(cls(), **flat)
