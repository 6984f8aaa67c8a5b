"""Catalogues of packages. A catalogue says where a module belongs if it is there, not that it is there."""

# Import names of declared Python distributions, by distribution.
PYTHON_MODULES = {
    "beautifulsoup4": ("bs4",),
    "django": ("django",),
    "fastapi": ("fastapi",),
    "flask": ("flask",),
    "httpx": ("httpx",),
    "mcp": ("mcp",),
    "numpy": ("numpy",),
    "pandas": ("pandas",),
    "pathspec": ("pathspec",),
    "pillow": ("PIL",),
    "pydantic": ("pydantic",),
    "pytest": ("pytest",),
    "python-dateutil": ("dateutil",),
    "pyyaml": ("yaml",),
    "requests": ("requests",),
    "scikit-learn": ("sklearn",),
    "sqlalchemy": ("sqlalchemy",),
    "starlette": ("starlette",),
    "tree-sitter": ("tree_sitter",),
    "tree-sitter-java": ("tree_sitter_java",),
    "tree-sitter-javascript": ("tree_sitter_javascript",),
    "tree-sitter-typescript": ("tree_sitter_typescript",),
    "uvicorn": ("uvicorn",),
    "watchfiles": ("watchfiles",),
}

# Packages of declared Java artifacts, by group and artifact.
JAVA_PACKAGES = {
    "com.fasterxml.jackson.core:jackson-annotations": ("com.fasterxml.jackson.annotation",),
    "com.fasterxml.jackson.core:jackson-core": ("com.fasterxml.jackson.core",),
    "com.fasterxml.jackson.core:jackson-databind": ("com.fasterxml.jackson.databind",),
    "com.google.code.gson:gson": ("com.google.gson",),
    "com.google.guava:guava": ("com.google.common",),
    "junit:junit": ("org.junit",),
    "org.apache.commons:commons-lang3": ("org.apache.commons.lang3",),
    "org.junit.jupiter:junit-jupiter-api": ("org.junit.jupiter.api",),
    "org.postgresql:postgresql": ("org.postgresql",),
    "org.slf4j:slf4j-api": ("org.slf4j",),
    "org.springframework:spring-beans": ("org.springframework.beans",),
    "org.springframework:spring-context": ("org.springframework.context", "org.springframework.stereotype"),
    "org.springframework:spring-core": ("org.springframework.core", "org.springframework.util"),
    "org.springframework:spring-jdbc": ("org.springframework.jdbc",),
    "org.springframework:spring-web": ("org.springframework.web",),
    "org.springframework.boot:spring-boot": ("org.springframework.boot",),
    "org.springframework.boot:spring-boot-autoconfigure": ("org.springframework.boot.autoconfigure",),
}

# Package families of Java SE 17.
JAVA_STANDARD = (
    "java",
    "javax.accessibility",
    "javax.annotation.processing",
    "javax.crypto",
    "javax.imageio",
    "javax.lang.model",
    "javax.management",
    "javax.naming",
    "javax.net",
    "javax.print",
    "javax.script",
    "javax.security.auth",
    "javax.security.sasl",
    "javax.sound",
    "javax.sql",
    "javax.swing",
    "javax.tools",
    "javax.transaction.xa",
    "javax.xml.crypto",
    "javax.xml.datatype",
    "javax.xml.namespace",
    "javax.xml.parsers",
    "javax.xml.stream",
    "javax.xml.transform",
    "javax.xml.validation",
    "javax.xml.xpath",
    "org.ietf.jgss",
    "org.w3c.dom",
    "org.xml.sax",
)
