"""Frameworks, linters, test runners, coverage and the kind of a repository, from the files that configure them.

Only files at known places are looked at, so a repository's are a map of bounded size that one aggregate gathers; all answers are
columns over it. files is (repo_id, path, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import manifests

# Files, names and patterns that decide the results, in their order.
FRAMEWORK_MARKERS = [
    ("next.config.js", "Next.js"), ("next.config.ts", "Next.js"), ("next.config.mjs", "Next.js"), ("nuxt.config.ts", "Nuxt"), ("nuxt.config.js", "Nuxt"),
    ("svelte.config.js", "SvelteKit"), ("svelte.config.ts", "SvelteKit"), ("angular.json", "Angular"), ("vite.config.ts", "Vite"), ("vite.config.js", "Vite"),
    ("remix.config.js", "Remix"), ("remix.config.ts", "Remix"), ("astro.config.mjs", "Astro"), ("astro.config.ts", "Astro"), ("gatsby-config.js", "Gatsby"),
    ("gatsby-config.ts", "Gatsby"), ("vue.config.js", "Vue CLI"), ("manage.py", "Django"), ("settings.py", "Django"), ("wsgi.py", "WSGI (Flask/Django)"),
    ("asgi.py", "ASGI (FastAPI/Django Channels)"), ("Cargo.toml", "Rust (Cargo)"), ("go.mod", "Go Modules"), ("pom.xml", "Maven (Java)"), ("build.gradle", "Gradle"),
    ("build.gradle.kts", "Gradle (Kotlin DSL)"), ("Gemfile", "Ruby (Bundler)"), ("composer.json", "PHP (Composer)"), ("pubspec.yaml", "Flutter/Dart"),
    ("mix.exs", "Elixir (Mix)"), ("rebar.config", "Erlang (Rebar)"), ("project.clj", "Clojure (Leiningen)"), ("stack.yaml", "Haskell (Stack)"),
    ("cabal.project", "Haskell (Cabal)"), ("flake.nix", "Nix"), ("Makefile", "Make"), ("CMakeLists.txt", "CMake"), ("terraform.tfstate", "Terraform"),
    ("main.tf", "Terraform"), ("serverless.yml", "Serverless Framework"), ("serverless.yaml", "Serverless Framework"), ("amplify.yml", "AWS Amplify"),
    ("vercel.json", "Vercel"), ("netlify.toml", "Netlify"), ("fly.toml", "Fly.io"), ("helm/Chart.yaml", "Helm"), ("Chart.yaml", "Helm"),
    ("docker-compose.yml", "Docker Compose"), ("docker-compose.yaml", "Docker Compose"), ("Dockerfile", "Docker"),
    (".devcontainer/devcontainer.json", "Dev Container"), ("devcontainer.json", "Dev Container"),
]
PYPI_FRAMEWORKS = [("fastapi", "FastAPI"), ("flask", "Flask"), ("sqlalchemy", "SQLAlchemy"), ("pydantic", "Pydantic")]
NPM_FRAMEWORKS = [("express", "Express"), ("@nestjs/core", "NestJS"), ("hono", "Hono"), ("elysia", "Elysia"), ("koa", "Koa"), ("fastify", "Fastify")]
NPM_LIBRARIES = [
    (["prisma", "@prisma/client"], "Prisma"), (["drizzle-orm"], "Drizzle ORM"), (["typeorm"], "TypeORM"), (["zod"], "Zod"), (["tailwindcss"], "Tailwind CSS"),
]
REACT_META = ["Next.js", "Remix", "Gatsby"]
APPS = ["Next.js", "Remix", "Gatsby", "Nuxt", "SvelteKit", "Angular"]
WEB_APPS = [*APPS, "React", "Vue CLI"]
SERVICES = ["Express", "NestJS", "FastAPI", "Flask", "Django", "Hono", "Fastify", "Elysia", "Koa", "tRPC"]
INFRASTRUCTURE = ["Terraform", "Helm", "Fly.io"]
BINARIES = ["Rust (Cargo)", "Go Modules"]
LINTERS = [
    (".eslintrc.js", "ESLint"), (".eslintrc.cjs", "ESLint"), (".eslintrc.ts", "ESLint"), (".eslintrc.json", "ESLint"), (".eslintrc.yaml", "ESLint"),
    ("eslint.config.js", "ESLint"), ("eslint.config.mjs", "ESLint"), ("eslint.config.ts", "ESLint"), (".prettierrc", "Prettier"), (".prettierrc.js", "Prettier"),
    (".prettierrc.json", "Prettier"), (".prettierrc.yaml", "Prettier"), ("ruff.toml", "Ruff"), (".ruff.toml", "Ruff"), (".pylintrc", "Pylint"), ("pylintrc", "Pylint"),
    (".flake8", "Flake8"), ("golangci-lint.yml", "golangci-lint"), (".golangci.yml", "golangci-lint"), (".golangci.yaml", "golangci-lint"), (".rubocop.yml", "RuboCop"),
    ("phpcs.xml", "PHP_CodeSniffer"), (".editorconfig", "EditorConfig"), ("biome.json", "Biome"), ("biome.jsonc", "Biome"), (".oxlintrc", "Oxlint"),
]
PYPROJECT_LINTERS = ["ruff", "black", "pylint", "flake8", "mypy", "pyright"]
JS_TEST_CONFIGS = [
    "vitest.config.ts", "vitest.config.js", "vitest.config.mjs", "jest.config.ts", "jest.config.js", "jest.config.cjs", "jest.config.json", "playwright.config.ts",
    "playwright.config.js", "cypress.config.ts", "cypress.config.js", "karma.conf.js", ".mocharc.js", ".mocharc.json", ".mocharc.yaml",
]
JS_RUNNERS = [("vitest", "vitest"), ("jest", "jest"), ("playwright", "Playwright"), ("cypress", "Cypress"), ("karma", "Karma"), ("mocha", "Mocha")]
PYTEST_CONFIGS = ["pytest.ini", "pyproject.toml", "tox.ini", "setup.cfg"]
COVERAGE_WORDS = [(["c8", '"coverage"'], "c8/v8"), (["nyc", "istanbul"], "NYC/Istanbul"), (["lcov"], "lcov")]
COVERAGE_CONFIGS = ["vitest.config.ts", "vitest.config.js", "jest.config.ts", "jest.config.js"]
THRESHOLD = r"(?s)threshold.*?lines.*?:.*?(\d+)"
# End of the fixed values.

_OTHERS = [
    "package.json", "setup.cfg", ".rspec", "phpunit.xml", "phpunit.xml.dist", "main.go", "src/main.rs", "src/lib.rs", "pyproject.toml", "pytest.ini", "tox.ini",
]
_KNOWN = sorted({p for p, _ in FRAMEWORK_MARKERS} | {p for p, _ in LINTERS} | {*JS_TEST_CONFIGS, *PYTEST_CONFIGS, *COVERAGE_CONFIGS, *_OTHERS})
_FOLDERS = ["spec", "test", "cmd"]


def configured(files: DataFrame) -> DataFrame:
    """(repo_id, at, folders, pypi): contents of the known files by path (empty where unread), known folders, names of PyPI."""
    known = F.col("path").isin(_KNOWN)
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1))
    each = files.groupBy("repo_id").agg(
        F.map_from_entries(F.collect_set(F.when(known, F.struct("path", F.coalesce("content", F.lit("")).alias("content"))))).alias("at"), F.collect_set(F.when(top.isin(_FOLDERS), top)).alias("folders"),
    )
    names = manifests.declared_names(files).where((F.col("ecosystem") == "pypi") & F.col("name").isin([n for n, _ in PYPI_FRAMEWORKS]))
    names = names.groupBy("repo_id").agg(F.collect_set("name").alias("pypi"))
    return each.join(names, "repo_id", "left").withColumn("pypi", F.coalesce("pypi", F.array().cast("array<string>")))


def _there(path: str) -> Column:
    return F.map_contains_key("at", path)


def _text(path: str) -> Column:
    return F.coalesce(F.try_element_at("at", F.lit(path)), F.lit(""))


def _found(pairs: list[tuple[Column, Column | str]]) -> Column:
    """The names whose condition holds, in order, the first of equal ones only."""
    each = [F.when(when, F.lit(name) if isinstance(name, str) else name) for when, name in pairs]
    return F.array_distinct(F.array_compact(F.array(*each)))


def frameworks() -> Column:
    """Over configured(): frameworks by markers, then by names of PyPI and npm, in the order of detection."""
    member = lambda name: F.from_json(F.get_json_object(_text("package.json"), f"$.{name}"), "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    both = F.map_concat(F.map_filter(F.coalesce(member("dependencies"), empty), lambda k, _: ~F.coalesce(F.map_contains_key(member("devDependencies"), k), F.lit(False))), F.coalesce(member("devDependencies"), empty))
    has = lambda name: F.map_contains_key(both, name)
    meta = [p for p, name in FRAMEWORK_MARKERS if name in REACT_META]
    spoken = F.concat_ws(" ", F.map_keys(both), F.map_values(both))
    pairs = [(_there(p), name) for p, name in FRAMEWORK_MARKERS] + [(F.array_contains("pypi", n), name) for n, name in PYPI_FRAMEWORKS]
    plain_react = has("react")
    for p in meta:
        plain_react = plain_react & ~_there(p)
    pairs += [(plain_react, "React"), *((has(n), name) for n, name in NPM_FRAMEWORKS), (spoken.contains("trpc"), "tRPC")]
    for names, name in NPM_LIBRARIES:
        any_of = has(names[0])
        for n in names[1:]:
            any_of = any_of | has(n)
        pairs.append((any_of, name))
    return _found(pairs)


def linters() -> Column:
    """Over configured(): (tool, file) of each linter and formatter; of several files of a tool, the last of the table."""
    entries = [(_there(p), tool, p) for p, tool in LINTERS]
    entries += [(_text("pyproject.toml").contains(f"[tool.{t}]"), t, "pyproject.toml") for t in PYPROJECT_LINTERS]
    entries.append((_text("setup.cfg").contains("[flake8]"), "flake8", "setup.cfg"))
    tools = {}
    for when, tool, path in entries:
        tools[tool] = F.when(when, path).otherwise(tools.get(tool, F.lit(None).cast("string")))
    return F.array_compact(F.array(*(F.when(path.isNotNull(), F.struct(F.lit(tool).alias("tool"), path.alias("file"))) for tool, path in tools.items())))


def test_setup() -> dict[str, Column]:
    """Over configured(): test_frameworks and test_configs in order, coverage_tooling, coverage_threshold."""
    runner = {p: next(name for token, name in JS_RUNNERS if token in p) for p in JS_TEST_CONFIGS}
    marked = {p: _text(p).contains("pytest") for p in PYTEST_CONFIGS}
    is_pytest = marked[PYTEST_CONFIGS[0]]
    first = F.coalesce(*(F.when(marked[p], p) for p in PYTEST_CONFIGS))
    for p in PYTEST_CONFIGS[1:]:
        is_pytest = is_pytest | marked[p]
    folder = lambda name: F.array_contains("folders", name)
    pairs = [(_there(p), runner[p]) for p in JS_TEST_CONFIGS] + [(is_pytest, "pytest"), (_there("go.mod"), "go test"), (_there("Cargo.toml"), "cargo test")]
    pairs += [(_there(".rspec") | folder("spec"), "RSpec"), (folder("test") & _there("Gemfile"), "Minitest"), (_there("phpunit.xml") | _there("phpunit.xml.dist"), "PHPUnit")]
    configs = F.array_compact(F.array(*(F.when(_there(p), p) for p in JS_TEST_CONFIGS), first))
    package = _text("package.json")
    spoken = [F.when(package.rlike("|".join(f"(?:\\Q{w}\\E)" for w in words)), name) for words, name in COVERAGE_WORDS]
    covered = [F.when(_text(p).contains("coverage"), f"configured in {p}") for p in COVERAGE_CONFIGS]
    python = F.when(_text("pyproject.toml").rlike("coverage|pytest-cov"), "pytest-cov")
    level = lambda p: F.when(_text(p).contains("coverage"), F.nullif(F.regexp_extract(_text(p), THRESHOLD, 1), F.lit("")).try_cast("int"))
    return {"test_frameworks": _found(pairs), "test_configs": configs, "coverage_tooling": F.coalesce(*spoken, *covered, python), "coverage_threshold": F.coalesce(*(level(p) for p in reversed(COVERAGE_CONFIGS)))}


def project_type(found: Column) -> Column:
    """Over configured() and the frameworks: library, web app, API service, mobile, infrastructure, CLI / service, CLI, unknown."""
    package = _text("package.json")
    is_any = lambda names: F.arrays_overlap(found, F.array(*map(F.lit, names)))
    main = F.get_json_object(package, "$.main")
    published = _there("package.json") & (F.coalesce(F.get_json_object(package, "$.private"), F.lit("")) != "true") & (F.coalesce(main, F.lit("")) != "") & ~is_any(APPS)
    rust = F.when(_there("src/main.rs") | _there("src/lib.rs"), F.when(_text("src/main.rs").contains("fn main()"), "CLI").otherwise("library"))
    binary = F.when(_there("main.go") | F.array_contains("folders", "cmd"), "CLI / service").otherwise(rust)
    kind = F.when(published, "library").when(is_any(WEB_APPS), "web app").when(is_any(SERVICES), "API service").when(F.array_contains(found, "Flutter/Dart"), "mobile").when(is_any(INFRASTRUCTURE), "infrastructure").when(is_any(BINARIES), binary)
    return F.coalesce(kind, F.lit("unknown"))


def toolchain(files: DataFrame) -> DataFrame:
    """(repo_id, frameworks, linters, test_frameworks, test_configs, coverage_tooling, coverage_threshold, project_type)."""
    rows = configured(files).withColumn("frameworks", frameworks())
    return rows.select("repo_id", "frameworks", linters().alias("linters"), *(c.alias(n) for n, c in test_setup().items()), project_type(F.col("frameworks")).alias("project_type"))
