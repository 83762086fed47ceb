"""Schemas of the relations that a source tree is read into. ord puts files in order; within one, its place is added."""

PLACE = "struct<ord:bigint,pos:int>"
FILES = "path string, name string, lang string, lines int, logic int, comments int, blanks int, funcs int, parsed boolean, ord bigint"
FUNCTIONS = f"path string, ord {PLACE}, name string, start_line int, end_line int, line_count int, cc int, cognitive int, param_count int, body_hash string"
CLASSES = f"path string, ord {PLACE}, name string, kind string, methods array<string>, bases array<string>"
IMPORTS = f"path string, ord {PLACE}, specifier string, resolved string"
CHANGES = f"hash string, author string, ts timestamp, path string, added bigint, deleted bigint, ord {PLACE}"

_FUNCTION = "struct<name:string,start_line:int,end_line:int,line_count:int,cc:int,cognitive:int,param_count:int,body_hash:string>"
_CLASS = "struct<name:string,kind:string,methods:array<string>,bases:array<string>>"
EXTRACTED = f"path string, ord bigint, lines int, logic int, comments int, blanks int, parsed boolean, functions array<{_FUNCTION}>, classes array<{_CLASS}>, specifiers array<string>"
