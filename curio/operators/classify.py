"""Binary text classifier on Spark ML (re-aim of the fine-tuned transformer).

tokens -> hashed term frequencies -> IDF -> logistic regression, optionally with
class weights 0.2 / 0.8 (the same weighted cross-entropy). Fitting runs on the executors;
``transform`` scores the pool batch-free and distributed. A model reads the internal column
``MODEL_TEXT``; train, predict and evaluate fill it from the caller's ``feature_col``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import classification_metrics

# --- fixed values ---------------------------------------------------------------------------
NEG_WEIGHT = 0.2           # class weights of the weighted loss (negative, positive)
POS_WEIGHT = 0.8
MAX_ITER = 20              # training passes
REG_PARAM = 0.01           # L2 penalty (weight decay)
NUM_FEATURES = 1 << 18
MODEL_TEXT = "_model_text"
# ---------------------------------------------------------------------------------------------


def class_weight_col(label_col: str = "label", weighted: Column | bool = True) -> Column:
    w = F.when(F.col(label_col) == 1, F.lit(POS_WEIGHT)).otherwise(F.lit(NEG_WEIGHT))
    if isinstance(weighted, bool):
        return w if weighted else F.lit(1.0)
    return F.when(weighted, w).otherwise(F.lit(1.0))


def with_model_text(df: DataFrame, feature_col: str) -> DataFrame:
    return df.withColumn(MODEL_TEXT, F.coalesce(F.col(feature_col), F.lit("")))


def feature_stages(num_features: int = NUM_FEATURES, max_tokens: int | None = None):
    """Feature stages over ``MODEL_TEXT``; every token counts unless the caller sets ``max_tokens``."""
    tok = RegexTokenizer(inputCol=MODEL_TEXT, outputCol="_tok", pattern=r"\W+", toLowercase=True, minTokenLength=1)
    words = f"slice(_tok, 1, {int(max_tokens)})" if max_tokens else "_tok"
    cut = SQLTransformer(statement=f"SELECT *, {words} AS _words FROM __THIS__")
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    return [tok, cut, tf, idf]


def text_features(df: DataFrame, feature_col: str = "title", max_tokens: int | None = None) -> DataFrame:
    """Fit the feature stages and return (…, features)."""
    d = with_model_text(df, feature_col)
    out = Pipeline(stages=feature_stages(max_tokens=max_tokens)).fit(d).transform(d)
    return out.withColumn("n_tokens", F.size("_words")).drop("_tok", "_words", "_tf", MODEL_TEXT)


def train_classifier(train: DataFrame, feature_col: str = "title", weighted: bool = False,
                     label_col: str = "label", max_tokens: int | None = None) -> PipelineModel:
    """Fit features + logistic regression on (text, label) rows only. Every optimizer iteration
    reads them again, so callers pass a written or persisted table."""
    d = with_model_text(train.select(feature_col, label_col), feature_col).withColumn("_y", F.col(label_col).cast("double"))
    lr = LogisticRegression(featuresCol="features", labelCol="_y", maxIter=MAX_ITER, regParam=REG_PARAM,
                            predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw")
    if weighted:
        d = d.withColumn("_w", class_weight_col(label_col))
        lr.setWeightCol("_w")
    return Pipeline(stages=feature_stages(max_tokens=max_tokens) + [lr]).fit(d)


def predict(model: PipelineModel, df: DataFrame, feature_col: str = "title",
            out_col: str = "predicted_label") -> DataFrame:
    """Add the predicted class (int) and the positive-class probability to every row."""
    cols = df.columns
    scored = model.transform(with_model_text(df, feature_col))
    p1 = vector_to_array(F.col("_prob"))[1]
    return scored.select(*[F.col(c) for c in cols], F.col("_pred").cast("int").alias(out_col),
                         p1.alias("score"))


def evaluate(model: PipelineModel, validation: DataFrame, feature_col: str = "title",
             label_col: str = "label") -> DataFrame:
    """accuracy / weighted precision / recall / F1 of the model on the validation table."""
    pred = predict(model, validation, feature_col, "prediction")
    return classification_metrics(pred, [], label_col, "prediction")
