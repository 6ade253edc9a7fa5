"""Prompt datasets: one projection per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import as_col
from ..functions.text import strip
from ..markers import SEGMENT_TAG

# Prompt texts and their one-shot examples.
REVIEW = """Assume you are expert at modifying the original code based on natural language descriptions.

Here is an example:

Old Code:
```java
{}
```

Description: 
{}

Modified Code:
```java
{}
```

Please modifie the following code based on the natural language description.

Old Code:
```java
{}
```

Description: 
{}

Modified Code:

"""
REVIEW_SHOT = (
    'protected static String commentFormat ( String comment ) { if ( comment == null || comment . isEmpty ( ) ) return " " ; while ( comment . getBytes ( ENCODING ) . length > 255 ) { comment = comment . substring ( 0 , comment . length ( ) - 1 ) ; } return comment ; }',
    'String.isEmpty() is avaible only as of JDK 1.6. Please use if (comment == null || comment.length() == 0) return ""; to keep this compilable with JDK 1.5',
    'protected static String commentFormat ( String comment ) { if ( comment == null || comment . length ( ) == 0 ) return " " ; while ( comment . getBytes ( ENCODING ) . length > 255 ) { comment = comment . substring ( 0 , comment . length ( ) - 1 ) ; } return comment ; }',
)
REFINE_DESCRIPTION = "Would it be better if add annotations to the parameters?"

BUGFIX = """Assume you are expert at fixing the buggy code based on guidance information.

Here is an example:

Buggy Code:
```java
{}
```

Guidance:
{}

Fixed Code:
```java
{}
```

Please fix the following code.

Buggy Code:
```java
{}
```
Guidance:
{}

Fixed: 

"""
BUGFIX_SHOT = (
    "return ( param == null ) || ( ! ( java.lang.Boolean . parseBoolean ( param ) ) ) ;",
    'private boolean isAuthenticationSupported ( org.apache.catalina.connector.Request request ) { java.lang.String param = request . getContext () . findParameter ( "basicAuth" ) ; return ( param == null ) || ( ! ( java.lang.Boolean . parseBoolean ( param ) ) ) ; } \n\nFixing basic authenticator issue',
    "return ( param != null ) && ( java.lang.Boolean . parseBoolean ( param ) ) ;",
)

REFINEMENT = """Assume you are expert at fixing the bug in the code.

Here is an example:

Buggy Code:
```java
{}
```

Fixed Code:
```java
{}
```

Please fix the following code.

Buggy Code:
```java
{}
```

Fixed: 

"""
REFINEMENT_SHOT = (
    "public char METHOD_1 ( java.lang.String VAR_1 , java.lang.String name ) { return null ; }",
    "public char METHOD_1 ( java.lang.String VAR_1 , java.lang.String name ) { return 0 ; }",
)

TRANSLATION = """Please translate the {} code to {} code.

Here is an example:
{} code: ```{}```.
{} code: ```{}```.

Please translate the following {} code to {} code.

The {} code is as follows:
```
{}
```

Output code is:
"""
TRANSLATION_SHOT = {
    "csharp": "public  static  string   StripExtension   ( string   filename    )   { int   idx  = filename   . IndexOf     ( '.'   )       ;  if ( idx   !=  - 1      ) { filename   =  filename   . Substring     ( 0   , idx   )      ;  }    return filename  ;  }",
    "java": "public static  String   stripExtension   ( String   filename    )   { int   idx   = filename   . indexOf   ( '.'  )       ;  if ( idx   !=  -  1      )   { filename   =  filename   . substring   ( 0  , idx  )      ;  }    return filename  ;  }`",
}


def fill_template(template: str, values: list[Column | str]) -> Column:
    """The template with each ``{}`` filled in order; plain strings are constants."""
    parts = template.split("{}")
    if len(parts) != len(values) + 1:
        raise ValueError(f"{len(parts) - 1} slots, {len(values)} values")
    cols = [F.lit(parts[0])]
    for value, tail in zip(values, parts[1:]):
        cols += [F.lit(value) if isinstance(value, str) else value, F.lit(tail)]
    return F.concat(*cols)


def segments(c) -> Column:
    return F.split(as_col(c), SEGMENT_TAG, -1)


def review_prompts(df: DataFrame, source: str = "input") -> DataFrame:
    seg = segments(source)
    return df.withColumn("prompt", fill_template(
        REVIEW, [*REVIEW_SHOT, strip(F.get(seg, F.lit(0))), strip(F.get(seg, F.lit(1)))]))


def bugfix_prompts(df: DataFrame, source: str = "input") -> DataFrame:
    seg = segments(source)
    guidance = F.array_join(F.slice(seg, F.lit(2), F.size(seg)), "\n")
    return df.withColumn("prompt", fill_template(
        BUGFIX, [*BUGFIX_SHOT, strip(F.get(seg, F.lit(0))), guidance]))


def refinement_prompts(df: DataFrame, source: str = "input") -> DataFrame:
    return df.withColumn("prompt", fill_template(REFINEMENT, [*REFINEMENT_SHOT, F.col(source)]))


def translation_prompts(df: DataFrame, from_lang: str, to_lang: str,
                        source: str = "input") -> DataFrame:
    shot = TRANSLATION_SHOT
    return df.withColumn("prompt", fill_template(TRANSLATION, [
        from_lang, to_lang, from_lang, shot[from_lang], to_lang, shot[to_lang],
        from_lang, to_lang, from_lang, F.col(source)]))


def refine_prompts(df: DataFrame, train: DataFrame, old: str = "old",
                   comment: str = "comment", idx: str = "idx") -> DataFrame:
    """The shot is the second training row: one row, read once; without it there is no prompt to build."""
    shot = train.where(F.col(idx) == 1).select("old", "new").take(1)
    if not shot:
        raise ValueError("the training table has no second row to show")
    return df.withColumn("prompt", fill_template(REVIEW, [
        shot[0]["old"], REFINE_DESCRIPTION, shot[0]["new"], strip(old), strip(comment)]))
