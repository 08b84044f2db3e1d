"""Column builders: numbers, dates, references, codes and similarities as expressions that stay in the JVM."""
