"""Frameworks of paths, by hand: order, lower case, slashes, barred parts, none."""

from pyspark.sql import functions as F

from graphloom.sources import frameworks

WANT = {
    "src/pages/Home.tsx": ("nextjs-pages", 3.0),
    "src/pages/_app.tsx": (None, 1.0),
    "src/pages/api/user.ts": ("nextjs-api", 3.0),
    "app/api/user/route.ts": ("nextjs-api", 3.0),
    "app/route.ts": (None, 1.0),
    "app/layout.tsx": ("nextjs-app", 2.0),
    "shop\\Views.py": ("django", 3.0),
    "api/x.py": ("python-api", 2.0),
    "api/__init__.py": ("api", 1.8),
    "x/routes/a.py": ("fastapi", 2.5),
    "x/routes/a.php": ("laravel", 3.0),
    "UserController.java": ("spring", 3.0),
    "main.go": ("go", 3.0),
    "domain.go": (None, 1.0),
    "Sources/ShopApp.swift": ("swiftui", 3.0),
    "Screens/HomeView.swift": ("uikit", 2.5),
    "": (None, 1.0),
    None: (None, 1.0),
}


def test_frameworks(spark):
    df = spark.createDataFrame([(p,) for p in WANT], "path string").withColumn("x", frameworks.framework(frameworks.normal_path(F.col("path"))))
    assert {r["path"]: (r["x"]["framework"], r["x"]["factor"]) for r in df.collect()} == WANT
