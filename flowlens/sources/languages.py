"""File name to language. A documented subset; pass your own rows to replace it."""

from __future__ import annotations

# ---- fixed values: language | file extensions ---------------------------------
EXTENSIONS = {
    "python": ".py .pyi .pyw", "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .mts .cts", "tsx": ".tsx",
    "go": ".go", "java": ".java", "kotlin": ".kt .kts", "scala": ".scala .sc", "groovy": ".groovy .gradle",
    "ruby": ".rb .rake .gemspec", "php": ".php", "c": ".c .h", "cpp": ".cc .cpp .cxx .hpp .hh .hxx",
    "c_sharp": ".cs", "rust": ".rs", "swift": ".swift", "objc": ".m .mm", "dart": ".dart", "lua": ".lua",
    "elixir": ".ex .exs", "erlang": ".erl .hrl", "haskell": ".hs", "ocaml": ".ml .mli", "julia": ".jl",
    "perl": ".pl .pm", "r": ".r", "zig": ".zig", "nim": ".nim", "bash": ".sh .bash", "powershell": ".ps1",
    "sql": ".sql", "html": ".html .htm", "css": ".css", "scss": ".scss", "vue": ".vue", "svelte": ".svelte",
    "yaml": ".yaml .yml", "toml": ".toml", "xml": ".xml", "hcl": ".hcl .tf .tfvars", "markdown": ".md .markdown",
    "proto": ".proto", "graphql": ".graphql .gql", "cmake": ".cmake",
}
FILE_NAMES = {"dockerfile": "Dockerfile", "make": "Makefile GNUmakefile", "ruby": "Gemfile Rakefile",
              "cmake": "CMakeLists.txt", "groovy": "Jenkinsfile"}
# ---- end of fixed values ------------------------------------------------------


def builtin_languages() -> list[tuple[str, str]]:
    """(pattern, language): a pattern starting with a dot is an extension, else an exact file name."""
    rows = [(ext, lang) for lang, exts in EXTENSIONS.items() for ext in exts.split()]
    rows += [(name, lang) for lang, names in FILE_NAMES.items() for name in names.split()]
    return rows
