"""Fit/transform preprocessing as ``pyspark.ml`` estimators.

Fitting is aggregation that leaves a small table of numbers; transforming is column expressions.
"""

from clientpulse.prep.assemble import FeatureAssembler, FeatureAssemblerModel
from clientpulse.prep.impute import CategoryImputer, CategoryImputerModel, NumericImputer, NumericImputerModel
from clientpulse.prep.means import FeatureMeans, FeatureMeansModel
from clientpulse.prep.outliers import OutlierCapper, OutlierCapperModel
from clientpulse.prep.scale import ColumnPicker, Scaler, ScalerModel, SignedLog, SignedLogModel
from clientpulse.prep.woe import WoeEncoder, WoeEncoderModel

__all__ = [
    "CategoryImputer",
    "CategoryImputerModel",
    "ColumnPicker",
    "FeatureAssembler",
    "FeatureAssemblerModel",
    "FeatureMeans",
    "FeatureMeansModel",
    "NumericImputer",
    "NumericImputerModel",
    "OutlierCapper",
    "OutlierCapperModel",
    "Scaler",
    "ScalerModel",
    "SignedLog",
    "SignedLogModel",
    "WoeEncoder",
    "WoeEncoderModel",
]
