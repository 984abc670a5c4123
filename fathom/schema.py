"""Categories, kinds, weights and limits that results must agree on."""

# Categories in display order, with the prior of search and of related files.
CATEGORIES = ["SourceCode", "Documentation", "Configuration", "Test", "Example", "ProjectMetadata", "Unknown"]
LABELS = ["Source code", "Documentation", "Configuration", "Tests", "Examples", "Project metadata", "Unknown"]
SEARCH_PRIOR = [0.30, 0.25, 0.20, 0.15, 0.10, 0.05, 0.0]
RELATED_PRIOR = [0.50, 1.25, 1.00, 1.50, 0.75, 0.25, 0.0]
CATEGORY_ALIASES = {
    "source": "SourceCode", "source-code": "SourceCode", "docs": "Documentation", "documentation": "Documentation", "configuration": "Configuration",
    "test": "Test", "tests": "Test", "example": "Example", "examples": "Example", "metadata": "ProjectMetadata", "project-metadata": "ProjectMetadata", "unknown": "Unknown",
}

# Scanner.
EXTENSIONS = ["rs", "md", "txt", "toml", "json"]
EXCLUSIONS = [".git", ".fathom", "target", "node_modules", "dist", "build", "coverage", ".idea", ".vscode"]
CONFIG_FILE, SNAPSHOT_FOLDER, SNAPSHOT_VERSION = ".fathom.toml", ".fathom", 1

# Search.
K1, B = 1.2, 0.75
FILE_NAME_BOOST, PATH_BOOST, SYMBOL_BOOST = 2.0, 1.0, 4.0

# Related files.
SYMBOL_WEIGHT, FILE_TERM_WEIGHT, MAX_SHARED_TERMS = 5.0, 2.0, 5
GENERIC_SYMBOLS = ["build", "default", "fmt", "from", "main", "new", "run", "test", "tests"]
RELATED_LIMIT = 20

# Symbols, in sort order.
SYMBOL_KINDS = ["Function", "Struct", "Enum", "Trait", "Implementation", "Module", "Constant", "Static", "TypeAlias", "Macro"]
KIND_LABELS = ["Function", "Struct", "Enum", "Trait", "Implementation", "Module", "Constant", "Static", "Type alias", "Macro"]
VISIBILITIES = ["Public", "Crate", "Restricted", "Private"]

# Documentation audit, kinds in sort order, confidences from high to low.
REFERENCE_KINDS = ["Path", "Symbol", "Command", "Option", "ConfigurationKey", "Module"]
REFERENCE_LABELS = ["File path", "Rust symbol", "CLI command", "CLI option", "Configuration key", "Rust module"]
CONFIDENCES = ["High", "Medium", "Low"]
FINDINGS = {
    "Path": ("High", "No matching repository path exists"),
    "Command": ("High", "No matching CLI command is defined"),
    "Option": ("High", "No matching CLI option is defined"),
    "Symbol": ("Medium", "No exact Rust symbol is indexed"),
    "Module": ("Medium", "No matching Rust module is indexed"),
    "ConfigurationKey": ("Low", "No matching configuration key is indexed"),
}
IGNORED_LINES = ["planned", "historical", "deprecated example", "deferred"]
GENERATED_FOLDERS = ["target/", "build/", "dist/", "node_modules/"]

# Project kinds.
PROJECT_KINDS = {
    "RustWorkspace": "Rust workspace",
    "RustLibraryAndCli": "Rust library and CLI application",
    "RustCli": "Rust CLI application",
    "RustLibrary": "Rust library",
    "RustPackage": "Rust package",
    "RustRepository": "Rust repository",
    "Unknown": "Unknown repository",
}
