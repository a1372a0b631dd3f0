"""Frameworks told by file paths: ordered rules of folders and name endings, the first that holds counts.

Paths are read in lower case with forward slashes and one slash before them.  A
path that no rule holds for, and a null one, has no framework and the factor 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders (any; none named: any path), endings (any), parts that must all be there, parts that must not be there, framework, factor, reason (fixed values).
RULES = (
    ("/pages/", ".tsx .ts .jsx .js", "", "/_ /api/", "nextjs-pages", 3.0, "nextjs-page"),
    ("/app/", "page.tsx page.ts page.jsx page.js", "", "", "nextjs-app", 3.0, "nextjs-app-page"),
    ("/pages/api/", "", "", "", "nextjs-api", 3.0, "nextjs-api-route"),
    ("/app/", "route.ts", "/api/", "", "nextjs-api", 3.0, "nextjs-api-route"),
    ("/app/", "layout.tsx layout.ts", "", "", "nextjs-app", 2.0, "nextjs-layout"),
    ("/routes/", ".ts .js", "", "", "express", 2.5, "routes-folder"),
    ("/controllers/", ".ts .js", "", "", "mvc", 2.5, "controllers-folder"),
    ("/handlers/", ".ts .js", "", "", "handlers", 2.5, "handlers-folder"),
    ("", "views.py", "", "", "django", 3.0, "django-views"),
    ("", "urls.py", "", "", "django", 2.0, "django-urls"),
    ("/routers/ /endpoints/ /routes/", ".py", "", "", "fastapi", 2.5, "api-routers"),
    ("/api/", ".py", "", "__init__.py", "python-api", 2.0, "api-folder"),
    ("/controller/ /controllers/", ".java", "", "", "spring", 3.0, "spring-controller"),
    ("", "controller.java", "", "", "spring", 3.0, "spring-controller-file"),
    ("/service/ /services/", ".java", "", "", "java-service", 1.8, "java-service"),
    ("/controllers/", ".cs", "", "", "aspnet", 3.0, "aspnet-controller"),
    ("", "controller.cs", "", "", "aspnet", 3.0, "aspnet-controller-file"),
    ("/pages/", ".razor", "", "", "blazor", 2.5, "blazor-page"),
    ("/handlers/ /handler/", ".go", "", "", "go-http", 2.5, "go-handlers"),
    ("/routes/", ".go", "", "", "go-http", 2.5, "go-routes"),
    ("/controllers/", ".go", "", "", "go-mvc", 2.5, "go-controller"),
    ("", "/main.go", "", "", "go", 3.0, "go-main"),
    ("/handlers/ /routes/", ".rs", "", "", "rust-web", 2.5, "rust-handlers"),
    ("", "/main.rs", "", "", "rust", 3.0, "rust-main"),
    ("/bin/", ".rs", "", "", "rust", 2.5, "rust-bin"),
    ("", "/main.c /main.cpp /main.cc", "", "", "c-cpp", 3.0, "c-main"),
    ("/src/", "/app.c /app.cpp", "", "", "c-cpp", 2.5, "c-app"),
    ("/routes/", ".php", "", "", "laravel", 3.0, "laravel-routes"),
    ("/http/controllers/ /controllers/", ".php", "", "", "laravel", 3.0, "laravel-controller"),
    ("", "controller.php", "", "", "laravel", 3.0, "laravel-controller-file"),
    ("/console/commands/ /commands/", ".php", "", "", "laravel", 2.5, "laravel-command"),
    ("/jobs/", ".php", "", "", "laravel", 2.5, "laravel-job"),
    ("/listeners/", ".php", "", "", "laravel", 2.5, "laravel-listener"),
    ("/http/middleware/", ".php", "", "", "laravel", 2.5, "laravel-middleware"),
    ("/providers/", ".php", "", "", "laravel", 1.8, "laravel-provider"),
    ("/policies/", ".php", "", "", "laravel", 2.0, "laravel-policy"),
    ("/models/", ".php", "", "", "laravel", 1.5, "laravel-model"),
    ("/services/", ".php", "", "", "laravel", 1.8, "laravel-service"),
    ("/repositories/", ".php", "", "", "laravel", 1.5, "laravel-repository"),
    ("", "/appdelegate.swift /scenedelegate.swift /app.swift", "", "", "ios", 3.0, "ios-app-entry"),
    ("/sources/", "app.swift", "", "", "swiftui", 3.0, "swiftui-app"),
    ("/viewcontrollers/ /controllers/ /screens/", ".swift", "", "", "uikit", 2.5, "uikit-viewcontroller"),
    ("", "viewcontroller.swift vc.swift", "", "", "uikit", 2.5, "uikit-viewcontroller-file"),
    ("/coordinators/", ".swift", "", "", "ios-coordinator", 2.5, "ios-coordinator"),
    ("", "coordinator.swift", "", "", "ios-coordinator", 2.5, "ios-coordinator-file"),
    ("/views/ /scenes/", ".swift", "", "", "swiftui", 1.8, "swiftui-view"),
    ("/services/", ".swift", "", "", "ios-service", 1.8, "ios-service"),
    ("/router/", ".swift", "", "", "ios-router", 2.0, "ios-router"),
    ("/api/", "/index.ts /index.js /__init__.py", "", "", "api", 1.8, "api-index"),
)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


def normal_path(path: Column) -> Column:
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(low, F.lit("/")), low).otherwise(F.concat(F.lit("/"), low))


def framework(path: Column) -> Column:
    """A struct (framework, factor, reason) of a path as ``normal_path`` gives it."""
    out = None
    for folders, endings, needed, barred, name, factor, reason in RULES:
        held = _any([F.contains(path, F.lit(x)) for x in folders.split()]) & _any([F.endswith(path, F.lit(x)) for x in endings.split()])
        held = reduce(lambda a, x: a & F.contains(path, F.lit(x)), needed.split(), held)
        held = reduce(lambda a, x: a & ~F.contains(path, F.lit(x)), barred.split(), held)
        found = F.struct(F.lit(name).alias("framework"), F.lit(factor).alias("factor"), F.lit(reason).alias("reason"))
        out = F.when(held, found) if out is None else out.when(held, found)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("framework"), F.lit(1.0).alias("factor"), F.lit(None).cast("string").alias("reason")))
